import pandas as pd
import pytest


@pytest.fixture(scope="session")
def table_of(spark, small):
    def load(name):
        return pd.read_parquet(f"{small}/{name}.parquet")
    return load
