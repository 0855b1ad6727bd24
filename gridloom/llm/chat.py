"""Chat formatting of logged conversations, after cumulative snapshots are collapsed.

Logs often hold a conversation again after each turn. Each turn gets a rolling hash of the turns up to
it: the xor of 64-bit hashes of (position, role, text), twice with different layouts, 128 bits in all, so
it can be added up in any split of a conversation. A conversation is dropped if its whole hash is the hash
of a proper prefix of another (an anti-join of distinct hashes), and of equal conversations that with the
smallest conv_id stays. What stays is rendered turn by turn.

Everything is DataFrame operations. Equal rows are collapsed and hashes made distinct before they are
shuffled, so a common first turn or conversation is one row; turns are dealt to ranges of their whole order
and numbered and hashed in blocks of at most BLOCK rows, whatever their turns say; the blocks' totals are then run up.

Defined results: conv_id and turn keep their types, and turns that are texts are ordered by the number that
they spell; turns are ordered by turn, role and text, nulls first, and repeated rows of a turn count
once; texts of any length are hashed whole; null and empty texts and roles render as empty but are different turns; a null conv_id is a
conversation like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import staged, staging, table

BLOCK = 256


def blocked(turns: DataFrame) -> DataFrame:
    """Distinct turns with ``at``, a number that grows with their order, and the block of at most BLOCK rows that it is in."""
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # Text turns are ordered by their number first, those without one before the others.
    number = F.col("turn").try_cast("bigint") if dict(turns.dtypes)["turn"] == "string" else F.col("turn").cast("bigint")
    order = ["conv_id", "number", "turn", "role", "text"]
    # Ranges of the whole order, so that a conversation of any length lies in many.
    ranged = rows.distinct().withColumn("number", number).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"))
    return numbered.withColumn("block", F.expr(f"at DIV {BLOCK}"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, position (from 0), h1, h2: the hash of the turns up to this one."""
    rows = staged(blocked(turns), "chat-turns")
    run = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).drop("n")
    before = staged(before, "chat-blocks")
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("at")) - 1)
    same = own["conv_id"].eqNullSafe(before["conv_id"]) & (own["block"] == before["block"])
    placed = own.join(before, same).select(own["conv_id"], "turn", "role", "text", own["block"], (F.col("before") + F.col("own")).alias("position"))
    part = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashed = placed.withColumn("e1", F.xxhash64("position", *part)).withColumn("e2", F.xxhash64(F.lit("second"), *reversed(part), "position"))
    hashed = staged(hashed, "chat-hashed")
    upto = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    blocks = hashed.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"))
    zero = F.lit(0).cast("long")
    blocks = staged(blocks.withColumn("b1", F.coalesce(F.bit_xor("b1").over(run), zero)).withColumn("b2", F.coalesce(F.bit_xor("b2").over(run), zero)), "chat-block-hashes")
    rolled = hashed.withColumn("r1", F.bit_xor("e1").over(upto)).withColumn("r2", F.bit_xor("e2").over(upto))
    same = rolled["conv_id"].eqNullSafe(blocks["conv_id"]) & (rolled["block"] == blocks["block"])
    return staged(
        rolled.join(blocks, same).select(rolled["conv_id"], "turn", "role", "text", "position", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2")),
        "chat-prefixes",
    )


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logs: conversations that are no proper prefix of another, one of each set of equal ones; n_logs equal ones."""
    ends = rolled.groupBy("conv_id").agg(F.max_by(F.struct("h1", "h2"), "position").alias("h"), (F.max("position") + 1).alias("n_turns"))
    ends = ends.select("conv_id", "n_turns", "h.h1", "h.h2")
    whole = staged(ends.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logs")), "chat-whole")
    # Each prefix of each distinct conversation; a conversation's last turn isn't a proper prefix of it.
    kept = whole.select(F.col("conv_id").alias("_id"), (F.col("n_turns") - 1).alias("_last"))
    proper = rolled.join(kept, rolled["conv_id"].eqNullSafe(kept["_id"]) & (F.col("position") < F.col("_last")))
    proper = staged(proper.select((F.col("position") + 1).alias("n_turns"), "h1", "h2").distinct(), "chat-proper")
    return whole.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_logs")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def apply(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logs, position, rendered: the turns of maximal conversations, ready to be joined end to end."""
    with staging(turns.sparkSession) as result:
        rolled = prefixes(turns)
        kept = result(maximal(rolled).withColumnRenamed("conv_id", "_id"), "chat-kept")
        rolled = result(rolled.select("conv_id", "role", "text", "position"), "chat-turns")
    joined = rolled.join(kept, rolled["conv_id"].eqNullSafe(kept["_id"]))
    return joined.select("conv_id", "n_turns", "n_logs", "position", rendered(F.col("role"), F.col("text")).alias("rendered"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
c AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY position) AS l, count(*) AS n_turns FROM t GROUP BY conv_id),
u AS (SELECT l, n_turns, min(conv_id) AS conv_id, count(*) AS n_logs FROM c GROUP BY l, n_turns),
p AS (SELECT DISTINCT list_slice(l, 1, i) AS l FROM (SELECT l, unnest(range(1, n_turns)) AS i FROM u)),
k AS (SELECT u.* FROM u ANTI JOIN p ON u.l = p.l)
SELECT t.conv_id, k.n_turns, k.n_logs, t.position, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id
"""
