"""Text functions of keyword search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DROPPED = str.maketrans("", "", '\\"+-*();')


def sanitize_query(query: str) -> str:
    """The query as keyword search takes it: comment marks and operator characters deleted (which
    joins the words beside them), single quotes doubled."""
    for mark in ("--", "/*", "*/"):
        query = query.replace(mark, "")
    return query.translate(_DROPPED).replace("'", "''")


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, in order; the doubled quotes of ``sanitize_query`` separate nothing new."""
    return list(dict.fromkeys(re.findall(r"[a-z]+", sanitize_query(query).lower())))


def tokens(*fields: Column) -> Column:
    """Runs of a-z in the lower-cased fields; digits are no tokens, so numbers cannot be found by keyword."""
    joined = F.concat_ws(" ", *fields)
    return F.array_remove(F.split(F.lower(joined), "[^a-z]+"), "")


def contains_ilike(field: Column, query: str) -> Column:
    """Case-insensitive substring match; ``%`` and ``_`` in the query act as wildcards, a backslash does not escape."""
    return field.ilike("%" + query.replace("\\", "\\\\") + "%")
