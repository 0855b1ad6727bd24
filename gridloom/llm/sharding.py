"""Minimax contiguous shards: ordered groups that stay whole are cut into k ranges whose largest is as small as possible.

The groups (of equal texts) are ordered by the SHA-256 of their text. A binary search finds the smallest
capacity with which the greedy rule (fill a shard until the next group doesn't fit) needs no more than k
shards; the cuts are the greedy ones at that capacity.

All rows stay in DataFrames. The search sees a summary of bounded size: sums over ranges of the order, at
first 65,536 of them (by the hash's first hex digits). A range can only matter to the exact answer if a
greedy cut can fall inside it for some capacity that is still possible; those few ranges are split by two
more digits, summed again, and so on, until every range in which a cut can fall is a single group. What
comes to the driver in one round is at most 65,536 or SPLIT times the ranges that a cut can fall in.

Numbers within a shard are dealt without a window over a whole shard: rows are counted by (shard, file of
the written table), and numbered within such a cell after the cells before it.

Defined results: a null text has size 1, CRC 0 and is one group with the empty text; repeated rows stay
together and get different slots; a group larger than the rest gets a shard of its own size; an empty
table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import staged, staging, table, without

SHARDS = 16
DIGITS = 4
SPLIT = 256
#: After every hex string.
END = "g"


def greedy(ends: list[int], capacity: int, k: int) -> list[int] | None:
    """Positions (one past the last atom) at which the k shards end; None if k don't hold all atoms.

    ``ends``: running totals of the atoms' sizes.
    """
    cuts, done = [], 0
    for _ in range(k):
        at = bisect_right(ends, done + capacity)
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (k - len(cuts))
        if at == (cuts[-2] if len(cuts) > 1 else 0):
            return None
        done = ends[at - 1]
    return None


def smallest(sizes: list[int], k: int) -> int:
    """The smallest capacity at which the greedy rule needs no more than k shards."""
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // k)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, k) is None:
            low = mid + 1
        else:
            high = mid
    return low


def open_ranges(sizes: list[int], single: list[bool], least: int, k: int) -> tuple[list[int], int, int]:
    """Ranges that aren't single groups and in which a greedy cut can fall, and bounds of the capacity.

    ``least``: a lower bound (the largest group, an equal share). The ranges as whole atoms give the upper
    bound; between the two, the j-th cut lies between what the smaller capacity surely reaches (whole
    ranges only) and what the larger can't pass.
    """
    ends = list(accumulate(sizes))
    high = smallest(sizes, k)
    low = max(least, -(-ends[-1] // k))
    starts = [e - s for e, s in zip(ends, sizes)]
    found: set[int] = set()
    first = last = 0
    for _ in range(k):
        first, last = first + low, last + high
        # The cut's range at the least: greedy fills up to the group in which ``first`` falls.
        a = bisect_left(ends, first)
        b = min(bisect_left(ends, last), len(ends) - 1)
        found.update(range(min(a, b), b + 1))
        if a >= len(ends):
            break
        # Within a range that may be split, a cut lies anywhere from its start on.
        first = min(first, starts[a]) if not single[a] else starts[a]
    return [i for i in sorted(found) if not single[i]], low, high


def cut_keys(groups: DataFrame, k: int = SHARDS) -> list[str]:
    """Where shards 1 to k - 1 start: prefixes of the first key, for groups (key: hex string, size, in a written table)."""
    digits = DIGITS
    rows = _ranges(groups, digits).collect()
    if not rows:
        return []
    atoms = sorted((r["p"], r["size"], r["n"] == 1) for r in rows)
    least = max(r["largest"] for r in rows)
    while True:
        todo, _, _ = open_ranges([a[1] for a in atoms], [a[2] for a in atoms], least, k)
        if not todo:
            break
        digits += 2
        names = [atoms[i][0] for i in todo]
        # Prefixes of different length are possible: each is matched at its own.
        prefix = F.lit(False)
        for n in sorted({len(x) for x in names}):
            prefix = prefix | F.substring("key", 1, n).isin([x for x in names if len(x) == n])
        inner = [(r["p"], r["size"], r["n"] == 1) for r in _ranges(groups.where(prefix), min(digits, 64)).collect()]
        gone = set(todo)
        atoms = sorted([a for i, a in enumerate(atoms) if i not in gone] + inner)
    sizes = [a[1] for a in atoms]
    cuts = greedy(list(accumulate(sizes)), smallest(sizes, k), k)
    return [atoms[c][0] if c < len(atoms) else END for c in cuts[:-1]]


def _ranges(groups: DataFrame, digits: int) -> DataFrame:
    return groups.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("n"))


def shard_of(key: Column, starts: list[str]) -> Column:
    """How many shards start at or before the key."""
    found = F.lit(0)
    for s in starts:
        found = found + (key >= s).cast("int")
    return found


def _cells(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_at", F.col("_metadata.row_index"))


def offsets(rows: DataFrame) -> DataFrame:
    """shard, _file, _block, _before: how many rows of the shard are in the cells before each (shard, part of a file)."""
    cells = staged(_cells(rows).groupBy("shard", "_file", "_block").agg(F.count(F.lit(1)).alias("_n")), "shard-cells")
    before = Window.partitionBy("shard").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")


def slots(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` (of a written table, with ``shard``) with ``slot``: numbers from 0 without gaps in each shard."""
    own = Window.partitionBy("shard", "_file", "_block").orderBy("_at")
    numbered = _cells(rows).withColumn("_own", F.row_number().over(own) - 1)
    return numbered.join(cells, ["shard", "_file", "_block"]).withColumn("slot", F.col("_before") + F.col("_own"))


def apply(docs: DataFrame, text: str = "text", k: int = SHARDS) -> DataFrame:
    """``docs`` without its text, with size, text_crc32, shard (0 to k - 1) and slot."""
    raw = docs[f"`{text}`"]
    data = F.coalesce(raw.cast("binary"), F.lit(b""))
    rest = without(docs, text, "size", "text_crc32", "shard", "slot")
    row = F.struct(F.lit(True).alias("_"), *[docs[f"`{c}`"] for c in rest.columns])
    rows = docs.select(row.alias("_row"), (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"), F.sha2(data, 256).alias("_key"))
    with staging(docs.sparkSession) as result:
        rows = result(rows, "shard-rows")
        groups = staged(rows.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("size")), "shard-groups")
        placed = rows.withColumn("shard", shard_of(F.col("_key"), cut_keys(groups, k)))
        cells = result(offsets(placed), "shard-offsets")
    return slots(placed, cells).select(*[F.col("_row").getField(c).alias(c) for c in rest.columns], "size", "text_crc32", "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
