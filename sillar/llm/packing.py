"""Filling containers of fixed capacity with texts.

Planned on the histogram of lengths, not on the documents: best-fit decreasing places all
items of one length at once, container groups being counted and not listed. The documents
then take the planned slots by their rank within their length. Only a text longer than
the capacity is divided: into full containers, and a rest that is packed like any other.

The histogram has at most as many rows as the capacity, so the plan on the driver does not
grow with the number of documents. Ranks come from running sums over range partitions,
so a length that a third of the documents share is no bottleneck.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.operators.ordered import running_sum
from sillar.llm.tokens import FOLDER, NAME, token_sizes
from sillar.session import cut

CAPACITY = 2048


@dataclass
class Group:
    """``bins`` containers filled alike: per length, how many items each holds."""

    bins: int
    free: int
    held: list[tuple[int, int]]


def plan(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing over counts. Every item goes where the least space is left of
    what suffices; groups of containers with the same history move together, and at most
    two groups split for each length, so there are few."""
    open_groups: dict[int, list[Group]] = {}  # by free space
    spaces: list[int] = []
    closed: list[Group] = []

    def put(group: Group) -> None:
        if group.free == 0:
            closed.append(group)
            return
        if group.free not in open_groups:
            open_groups[group.free] = []
            bisect.insort(spaces, group.free)
        open_groups[group.free].append(group)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect.bisect_left(spaces, size)
            if at == len(spaces):
                each = capacity // size
                bins, rest = divmod(left, each)
                if bins:
                    put(Group(bins, capacity - each * size, [(size, each)]))
                if rest:
                    put(Group(1, capacity - rest * size, [(size, rest)]))
                break
            free = spaces[at]
            group = open_groups[free].pop()
            if not open_groups[free]:
                del open_groups[free]
                spaces.pop(at)
            each = free // size
            bins = min(group.bins, left // each)
            if bins:
                put(Group(bins, free - each * size, [*group.held, (size, each)]))
                left -= bins * each
            spare = group.bins - bins
            if spare and 0 < left < each:
                put(Group(1, free - left * size, [*group.held, (size, left)]))
                spare, left = spare - 1, 0
            if spare:
                put(Group(spare, free, group.held))
    return closed + [g for space in spaces for g in open_groups[space]]


def slots(groups: list[Group]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first container and items per container of each stretch of slots."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for group in groups:
        for size, each in group.held:
            found.setdefault(size, []).append((used.get(size, 0), first, each))
            used[size] = used.get(size, 0) + each * group.bins
        first += group.bins
    return {size: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for size, rows in found.items()}


def _place(table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(b.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
            ranks = b.column(b.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            out = np.zeros(b.num_rows, dtype=np.int64)
            for size in np.unique(sizes):
                starts, firsts, each = table[int(size)]
                rows = np.flatnonzero(sizes == size)
                at = np.searchsorted(starts, ranks[rows], side="right") - 1
                out[rows] = shift + firsts[at] + (ranks[rows] - starts[at]) // each[at]
            names = ["doc_id", "piece", "tok_start", "size"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(out)], names=["doc_id", "piece", "tok_start", "tokens", "container"])

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``(doc_id, piece, tok_start, tokens, container)``: where each non-blank text goes.

    A text of at most ``capacity`` tokens is one piece (0). A longer one fills containers of
    its own with pieces of ``capacity`` tokens, in order, and its rest is packed with the
    others. Rows with the same ``doc_id`` are packed each. Null and blank texts are left
    out; an empty table gives no rows.
    """
    sizes = cut(token_sizes(documents, "doc_id", "text", folder=folder, name=name).filter("tokens > 0").withColumn("full", F.expr(f"cast(tokens div {capacity} as long)")))
    rest = F.col("tokens") - F.col("full") * capacity
    items = sizes.filter(rest > 0).select("doc_id", F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).alias("tok_start"), rest.cast("int").alias("size"), F.coalesce("doc_id", F.lit(-1)).alias("tie"))
    histogram = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}
    groups = plan(histogram, capacity)
    ranked = running_sum(items, "size", ["tie", "piece"], name="rank")
    spec = "doc_id long, piece int, tok_start long, tokens int, container long"
    packed = ranked.mapInArrow(_place(slots(groups), 0), spec)
    whole = sizes.filter("full > 0").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"), F.lit("all").alias("every"))
    whole = running_sum(whole, "every", ["doc_id", "piece"], name="rank")
    used = sum(g.bins for g in groups)
    return packed.unionByName(whole.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("tok_start"), F.lit(capacity).alias("tokens"), (F.col("rank") + used).alias("container")))


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(containers, least, items, tokens, filled, fullest)``: how many containers, the least
    number that could do, and the share of their capacity that is used."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    total = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"))
    return total.select("containers", F.ceil(F.col("tokens") / capacity).alias("least"), "items", "tokens", F.round(F.col("tokens") / F.nullif(F.col("containers") * capacity, F.lit(0)), 6).alias("filled"), "fullest")
