"""Problem 7: filling fixed-capacity containers, by a configuration linear program over the length histogram.

The items' lengths are counted into a histogram of at most ``capacity`` cells. On the driver the
covering program over configurations (multisets of lengths that fit) is solved by multiplicative
weights: prices fall with the coverage a length has already got, a knapsack dynamic program finds
the best configuration for the prices, and the mean of the configurations found is a fractional
solution. It is rounded down to whole containers; what is left is filled from the histogram, largest
length first, and where that leaves room by a subset-sum dynamic program over the lengths left. All of
that works on at most ``capacity`` numbers whatever the data.
Items then find their container by their rank among the items of the same length: ranks come from
per-task counts and prefix sums, so no length is ever gathered in one task.

Defined results: an item longer than the capacity is divided into full pieces and a rest, all others
stay whole; null and empty texts have length 0 and go to container 0; repeated rows are items of
their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import durable, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})


def token_lengths(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens): the number of tokens of every row's whole text."""
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = dict(rows.dtypes)["id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], names=["id", "tokens"])

    return rows.mapInArrow(count, f"id {kind}, tokens long")


def knapsack(prices: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of lengths (index + 1 is a length) of highest total price that fits, by dynamic programming."""
    value = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = value[c - 1 :: -1][: len(prices)] + prices[:c]
        best = int(np.argmax(total))
        value[c], pick[c] = total[best], best + 1
        if value[c - 1] >= value[c]:
            value[c], pick[c] = value[c - 1], 0
    counts = np.zeros(len(prices), np.int64)
    c = capacity
    while c > 0:
        if pick[c]:
            counts[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return counts


def _weights(wanted: np.ndarray, capacity: int, rounds: int, rate: float) -> dict[bytes, float]:
    """Configurations and how many containers of each, from multiplicative weights on the covering program.

    A length's weight is exp(-rate x the share of its demand that is covered); each round takes the
    best configuration for weight / demand and as many containers of it as cover one of its lengths.
    """
    present = wanted > 0
    covered = np.zeros(capacity)
    found: dict[bytes, float] = {}
    if not present.any():
        return found
    for _ in range(rounds):
        share = np.where(present, covered / np.maximum(wanted, 1), 0.0)
        prices = np.where(present, np.exp(-rate * (share - share[present].min())) / np.maximum(wanted, 1), 0.0)
        config = np.minimum(knapsack(prices, capacity), wanted)
        used = config > 0
        if not used.any():
            break
        step = float((wanted[used] / config[used]).min())
        covered += step * config
        found[config.tobytes()] = found.get(config.tobytes(), 0.0) + step
    mean = float((covered[present] / wanted[present]).mean())
    return {c: x / max(mean, 1e-9) for c, x in found.items()}


def _fullest(left: np.ndarray, room: int) -> dict[int, int]:
    """{length: count} out of ``left`` that fills most of ``room``, with the large lengths preferred."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for s in (np.flatnonzero(left[:room] > 0)[::-1] + 1).tolist():
        steps.append((s, reach))
        n, k = min(int(left[s - 1]), room // s), 1
        while n > 0:
            m = min(k, n)
            reach |= (reach << (m * s)) & mask
            n, k = n - m, 2 * k
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for s, before in reversed(steps):
        while not before >> at & 1:
            at -= s
            out[s] = out.get(s, 0) + 1
    return out


def _rounded(histogram: np.ndarray, capacity: int, found: dict[bytes, float], depth: float) -> list[tuple[np.ndarray, int]]:
    """Whole containers from ``depth`` times the fractional solution; what is left goes largest first."""
    left = histogram.astype(np.int64).copy()
    size = np.arange(1, capacity + 1)
    plan: list[tuple[np.ndarray, int]] = []

    def take(config: np.ndarray, most: int) -> None:
        used = config > 0
        times = min(most, int((left[used] // config[used]).min()))
        if times > 0:
            plan.append((config, times))
            left[used] -= times * config[used]

    for raw, x in sorted(found.items(), key=lambda z: (-z[1], z[0])):
        config = np.frombuffer(raw, np.int64)
        # A configuration that leaves room is left to the greedy part, which can fill that room.
        if int(x * depth) and int(config @ size) == capacity:
            take(config, int(x * depth))
    while left.any():
        config, room = np.zeros(capacity, np.int64), capacity
        while room > 0:
            fits = np.flatnonzero((left - config)[:room] > 0)
            if not len(fits):
                break
            config[fits[-1]] += 1
            room -= int(fits[-1]) + 1
        if room and room < capacity and left.sum() > config.sum():
            first = int(np.flatnonzero(config)[-1])
            config = np.zeros(capacity, np.int64)
            config[first] = 1
            for s, n in _fullest(left - config, capacity - first - 1).items():
                config[s - 1] += n
        take(config, int(left.max()))
    return plan


def solve(histogram: np.ndarray, capacity: int, rounds: int = 300, rate: float = 1.0) -> list[tuple[np.ndarray, int]]:
    """[(configuration, containers)] that hold exactly ``histogram`` (cell i counts the items of length i + 1).

    The fractional solution is rounded at several depths, since rounding all of it can use up the
    small items that the rest would need; the plan with the fewest containers is kept.
    """
    found = _weights(histogram.astype(np.int64), capacity, rounds, rate)
    plans = [_rounded(histogram, capacity, found, depth) for depth in (1.0, 0.8, 0.6, 0.4)]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def pack(items: DataFrame, capacity: int = 2048, rounds: int = 300) -> DataFrame:
    """(id, piece, start, tokens, container) for rows (id, tokens): ``start`` is the piece's first token in its item."""
    kind = dict(items.dtypes)["id"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Divide long items and number the pieces of each length within the task."""
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            n = b.column("tokens").to_numpy()
            pieces = np.maximum(1, -(-n // capacity))
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(n[row] - piece * capacity, capacity)
            order = np.argsort(size, kind="stable")
            sizes, counts = np.unique(size, return_counts=True)
            local = np.empty(len(row), np.int64)
            local[order] = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen[sizes], counts)
            seen[sizes] += counts
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.full(len(row), task, np.int32)), pa.array(local)], names=["id", "piece", "tokens", "task", "local"])

    numbered = durable(items.mapInArrow(number, f"id {kind}, piece int, tokens int, task int, local long"), "numbered-items")
    counts = durable(numbered.groupBy("tokens", "task").agg(F.count("*").alias("n")), "length-counts")
    histogram = np.zeros(capacity, np.int64)
    for r in counts.groupBy("tokens").agg(F.sum("n").alias("n")).where("tokens > 0").collect():
        histogram[r["tokens"] - 1] = r["n"]
    # For each length: where its ranks change configuration, how many of it a container there holds, and the first container.
    upto: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    done = np.zeros(capacity, np.int64)
    for config, times in solve(histogram, capacity, rounds):
        for s in np.flatnonzero(config):
            upto.setdefault(int(s) + 1, []).append((int(done[s]), int(config[s]), first, 0))
            done[s] += times * config[s]
        first += times
    slots = numbered.sparkSession.sparkContext.broadcast({s: np.array(v, np.int64) for s, v in upto.items()})
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("tokens").orderBy("task")) - F.col("n")).select("tokens", "task", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("tokens").to_numpy()
            rank = b.column("before").to_numpy() + b.column("local").to_numpy()
            container = np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            sizes, counts = np.unique(size, return_counts=True)
            for s, part in zip(sizes, np.split(order, np.cumsum(counts)[:-1])):
                if s:
                    table = slots.value[int(s)]
                    at = np.searchsorted(table[:, 0], rank[part], "right") - 1
                    container[part] = table[at, 2] + (rank[part] - table[at, 0]) // table[at, 1]
            piece = b.column("piece").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("piece"), pa.array(piece.astype(np.int64) * capacity), b.column("tokens"), pa.array(container)], names=["id", "piece", "start", "tokens", "container"])

    return numbered.join(before, ["tokens", "task"]).mapInArrow(place, f"id {kind}, piece int, start long, tokens int, container long")
