"""SimHash near-duplicates by meeting in the middle of Hamming balls.

Fingerprints of 64 bits are linked at RADIUS = 3 differing bits or fewer. Two fingerprints within 3
bits have a variant at most 1 bit from one of them and at most 2 bits from the other, and if they
are exactly 3 bits apart their parities differ. So every fingerprint emits its variants within 1 bit
and those of even parity emit theirs at 2 bits too; rows are shuffled on the variant. In a variant's
bucket each member is linked to one hub, the smallest that is within 1 bit of the variant: member
and hub are then within 2 + 1 bits, so each of these links is verified by construction (and checked
again by counting bits), no pair within a group is enumerated, and every true link is found between
its two ends' hubs. A bucket can't hold more than the 2081 fingerprints within 2 bits of the variant.

Before that, fingerprints without any neighbour are set aside at a fiftieth of the cost by the same
meeting in halves: within 3 bits, one 32-bit half differs in at most 1 bit, and then that half of the
one with odd parity, with one bit flipped, is that half of the other. Only fingerprints that share
such a half emit the ball.

Defined results: a null or blank text has the fingerprint zero and is linked like any other; repeated
rows are each returned; a null document number is never a component's number unless the component has
no other; a text of any length is read whole; an empty table gives an empty result; other columns are
ignored, and `keep` returns all columns whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import LOWER, as_bytes, bounded_batches, bounded_broadcasts, packed, row_map, staged, staging, table, unpacked, unstaged, without

SHINGLE = 3
SEED = 42
RADIUS = 3
#: What ``keep`` holds to be a near copy besides: sets of so many words, similar in so many of a thousand.
KEEP_SHINGLE, KEEP_PERMILLE = 5, 800
#: One of so many texts is asked for common shingles; so many shingles are told apart from the rare ones.
SAMPLE, MOST_COMMON = 16, 200_000
#: Shingles up to which texts are compared by their sets at once.
FEW = 128
#: Texts with one shingle that are compared pair by pair at once, and rounds before all that are apart are.
CROWD, ROUNDS = 32, 8
#: Times that what is apart after the rounds is told apart by differences from a text, before all pairs left are compared.
LEVELS = 4
#: Pairs for each shingle of a crowd's texts that are compared without that.
MANY = 2
#: A shingle that more than one in so many members of a hub has is put last.
OFTEN = 64
#: Shingles, and texts, that are shuffled are taken in so many parts at most, one after the other, so that only one part is on disk
#: at a time; fewer for tables with less than so many shingles a part, as each part costs the driver jobs.
SLICES, SLICE = 8, 5_000_000


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of ``size`` words; of the whole sequence if there are fewer words."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(joined, seed)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    return [h(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit j is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 14):
        some = hashes[start : start + (1 << 14)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int((np.uint64(1) << _SHIFTS)[2 * ones > len(hashes)].sum(dtype=np.uint64))


def _fingerprints(column: pa.Array) -> list[pa.Array]:
    found = np.zeros(len(column), dtype=np.uint64)
    for i, text in enumerate(column.to_pylist()):
        if text:
            found[i] = fingerprint(np.array(shingle_hashes(text), dtype=np.uint64))
    return [pa.array(found.view(np.int64))]


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a long; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    df = without(docs, "fp", "_text").withColumn("_text", as_bytes(F.col(text)))
    return row_map(df, "_text", [T.StructField("fp", T.LongType())], lambda: _fingerprints, keep)


def _odd(x: Column) -> Column:
    return F.bit_count(x) % 2 == 1


def _masks(values: list[int]) -> Column:
    return F.lit(np.array(values, dtype=np.uint64).view(np.int64).tolist())


def _flips(x: Column, masks: list[int]) -> Column:
    return F.transform(_masks(masks), lambda m: x.bitwiseXOR(m))


def _parts() -> Column:
    """The two halves of a fingerprint."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32)
    return F.array(F.struct(F.lit(0).alias("half"), low.alias("value")), F.struct(F.lit(1).alias("half"), high.alias("value")))


_HALF_FLIPS = [1 << i for i in range(32)]


def crowded(fps: DataFrame) -> DataFrame:
    """fp, with ``wide`` true where the ball of 2 bits is needed: those that share a half, of distinct ``fps``.

    Halves of odd parity are dealt out with each bit flipped too, and places where two fingerprints met are
    noted. The places then fetch their members the other way round: a few places with the halves that can
    have reached them, joined to two rows of each fingerprint, so that the many flips aren't shuffled twice.
    """
    parts = fps.select("fp", F.explode(_parts()).alias("p")).select("fp", "p.half", "p.value")
    value = F.col("value")
    reached = F.when(_odd(value), F.concat(F.array(value), _flips(value, _HALF_FLIPS))).otherwise(F.array(value))
    met = parts.select("fp", "half", F.explode(reached).alias("near")).groupBy("half", "near").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.max(F.bit_count("fp") % 2).alias("odd"))
    met = staged(met.where("a <> b").select("half", "near", "odd"), "simhash-met")
    near = F.col("near")
    sources = F.when(_odd(near), F.array(near)).otherwise(F.concat(F.array(near), _flips(near, _HALF_FLIPS)))
    # Spark's estimate of this side leaves out the flips, so it would be broadcast at 33 times the size that is meant to be.
    hits = parts.join(met.select("half", "odd", F.explode(sources).alias("value")).hint("merge"), ["half", "value"]).groupBy("fp").agg(F.max("odd").alias("odd"))
    return hits.select("fp", ((F.bit_count("fp") % 2 == 0) & (F.col("odd") == 1)).alias("wide"))


def _ball(fps: DataFrame) -> DataFrame:
    """fp, variant, shell: variants within 1 bit, and where ``wide`` those at 2 bits."""
    x = F.col("fp")
    near = F.concat(F.array(x), _flips(x, [1 << i for i in range(64)]))
    far = _flips(x, [(1 << i) | (1 << j) for i in range(64) for j in range(i)])
    return fps.select(x, F.explode(near).alias("variant"), F.lit(0).alias("shell")).unionAll(fps.where("wide").select(x, F.explode(far).alias("variant"), F.lit(1).alias("shell")))


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints within RADIUS bits, enough to connect all that are linked."""
    from pyspark.sql import Window

    some = staged(crowded(fps), "simhash-crowded")
    # At most 2081 rows have one variant, so no partition of this window is large.
    by = Window.partitionBy("variant").orderBy("shell", "fp")
    met = _ball(some).select("fp", F.first("fp").over(by).alias("hub"), F.first("shell").over(by).alias("hub_shell"))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub")))
    return met.where((F.col("hub_shell") == 0) & (F.col("fp") != F.col("hub")) & (far <= RADIUS)).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of the edges (a, b) the smallest node it is connected with; a written table.

    Alternates large-star and small-star steps until every node hangs on a root, which takes a number of
    rounds logarithmic in a component's size. Each round's tables are written and reread, so that no lineage
    grows and Spark can split the rows of a hub in the joins.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    while not _is_forest_of_stars(e):
        # Large star: every neighbour that is larger than u goes to the smallest in u's neighbourhood.
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "components-low")
        large = staged(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "components-large")
        discard(low, e)
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "components-low")
        e = staged(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "components-small")
        discard(low, large)
    out = staged(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components-roots")
    discard(e)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read again."""
    for t in tables:
        if t is not None:
            unstaged(t)


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether each u has one v only, and no v is a u itself."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def classes(marked: DataFrame, key: str = "doc_id", more: DataFrame | None = None) -> DataFrame:
    """``marked`` (with ``fp``) with ``component_id``, the smallest key of what its fingerprint is connected with, and ``root``, its fingerprint.

    ``more`` has further links (a, b) of fingerprints.

    Exact copies share a fingerprint and are added up before anything else; the last join's sides are
    written tables, so Spark can split a fingerprint that a large part of all rows has.
    """
    fps = staged(marked.groupBy("fp").agg(F.min(key).alias("least")), "simhash-fps")
    found = links(fps.select("fp"))
    roots = components(found if more is None else found.unionByName(more))
    joined = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = staged(joined, "simhash-joined")
    discard(fps, roots)
    named = staged(joined.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-named")
    of = staged(joined.join(named, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "simhash-of")
    discard(joined, named)
    return without(marked, "component_id", "root").join(of, F.col("fp") == F.col("_fp"), "left").drop("_fp")


def apply(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp, component_id of every row."""
    with bounded_broadcasts(docs.sparkSession), staging(docs.sparkSession) as result:
        return result(classes(staged(with_fingerprint(docs, text, [key]), "simhash-marked"), key), "simhash-classes")


def _grams(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(np.array(shingle_hashes(text, size) if text else [], dtype=np.uint64).view(np.int64))


def _arrays(found: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*found, np.zeros(0, dtype=np.int64)])))


def parities(grams: np.ndarray) -> np.ndarray:
    """A bit for each remainder of the hashes, set if an odd number of them has it; four bits a hash or more, a power of two."""
    bits = max(256, 1 << int(4 * len(grams) - 1).bit_length())
    odd = np.bincount(grams & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _common(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that many texts of a sample have, the rarest first. They only order the shingles, so a miss costs time and no pair.

    The driver gets how many shingles have each count, then about MOST_COMMON shingles in all, whatever the number of partitions.
    """
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(as_bytes(F.col("text")).alias("_text")).distinct()
    grams = row_map(some, "_text", [T.StructField("grams", T.ArrayType(T.LongType()))], lambda: lambda c: [_arrays([_grams(t, size) for t in c.to_pylist()])], [])
    counts = staged(grams.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 3"), "simhash-common")
    room, chosen = MOST_COMMON, F.lit(False)
    for n, k in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect():
        if k > room:
            # Of the last count a part, by hashes.
            chosen = (F.col("n") > n) | ((F.col("n") == n) & (F.pmod(F.xxhash64("g"), F.lit(k)) < room))
            break
        room, chosen = room - k, F.col("n") >= n
    found = counts.where(chosen).toArrow()
    unstaged(counts)
    g, n = (found[c].to_numpy() for c in ("g", "n"))
    return g[np.lexsort((g, n))]


_PROFILE = ["fp", "node", "n", "prefix", "bits", "whole"]
_PROFILE_FIELDS = [T.StructField(n, t) for n, t in zip(_PROFILE, [T.LongType(), T.LongType(), T.IntegerType(), *[T.ArrayType(T.LongType())] * 3])]


def _profiles(common: np.ndarray, size: int, permille: int):
    """fp, node (a hash of fp and the shingles), n, of the n shingles in order of rarity those of which a similar text must share one, and for comparisons their parities or, of few, all."""
    by = np.argsort(common)
    known = common[by]

    def run(column: pa.Array) -> list[pa.Array]:
        nodes, counts, prefixes, bits, whole = np.zeros(len(column), dtype=np.uint64), [], [], [], []
        fps = _fingerprints(column)[0]
        none = np.zeros(0, dtype=np.int64)
        for i, (text, fp) in enumerate(zip(column.to_pylist(), fps.to_pylist())):
            grams = _grams(text, size)
            nodes[i] = xxhash.xxh64_intdigest(grams.tobytes(), fp % (1 << 64))
            rank = np.full(len(grams), -1)
            if len(known):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                rank = np.where(known[at] == grams, by[at], -1)
            counts.append(len(grams))
            prefixes.append(grams[np.argsort(rank, kind="stable")][: len(grams) - -(-permille * len(grams) // 1000) + 1 if len(grams) else 0])
            # A similar text of FEW shingles or fewer has no more than this.
            whole.append(grams if len(grams) <= 1000 * FEW // permille else none)
            bits.append(parities(grams) if len(grams) > FEW else none)
        return [fps, pa.array(nodes.view(np.int64)), pa.array(counts, pa.int32()), _arrays(prefixes), _arrays(bits), _arrays(whole)]

    return run


def compared(pairs: DataFrame, nodes: DataFrame, permille: int) -> DataFrame:
    """a, b, sure: the pairs (a, b, n_a, n_b) that can be similar; ``sure`` if they are, else their texts must be compared.

    Two sets are similar if no more than ``most`` shingles are in one only. With FEW shingles or fewer in one of them
    that is counted. Else the parities differ in no more bits than that, so that no similar pair is missed; in fewer
    only by shingles that fall together, of which more than six deviations over the expected number are left to
    the comparison of the texts.
    """
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("bits").alias(f"bits_{x}"), F.col("whole").alias(f"whole_{x}"))
    df = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.col("n_a") + F.col("n_b")
    most = F.floor((1000 - permille) * both / (1000 + permille)).cast("int")
    # Sizes are within a factor of two; the longer parities are folded.
    size = F.least(F.size("bits_a"), F.size("bits_b"))
    folded = lambda x: F.when(F.size(x) > size, F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))
    differ = F.aggregate(F.zip_with(folded("bits_a"), folded("bits_b"), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, x: s + x)
    few = F.least("n_a", "n_b") <= FEW
    apart = F.when(few, both - 2 * F.size(F.array_intersect("whole_a", "whole_b"))).otherwise(differ)
    df = df.select("a", "b", "n_a", "n_b", few.alias("few"), most.alias("most"), apart.alias("apart"), (F.col("most") * F.col("most") / (128 * F.greatest(size, F.lit(1)))).alias("together")).where("apart <= most")
    margin = 2 * (F.col("together") + 6 * F.sqrt("together") + 3)
    return df.select("a", "b", "n_a", "n_b", (F.col("few") | (F.col("apart") + margin <= F.col("most"))).alias("sure"))


def sets_of(docs: DataFrame, nodes: DataFrame, ends: DataFrame, size: int, slices: int) -> list[DataFrame]:
    """node, grams: the sets of shingles of the nodes in ``ends``, from their texts; ``slices`` written tables, as the texts move in so many parts."""
    at = staged(nodes.select("node", "_k1", "_k2").join(ends, "node", "left_semi"), "simhash-at")
    parts = []
    for i in range(slices):
        mine = F.pmod("_k1", F.lit(slices)) == i
        texts = docs.where(mine).select("_k1", "_k2", as_bytes(F.col("text")).alias("_text")).join(at.where(mine), ["_k1", "_k2"])
        # Repeated rows go here, where texts of one key are together, so that sets don't move.
        texts = texts.groupBy("_k1", "_k2").agg(F.first("node").alias("node"), F.first("_text").alias("_text"))
        sets = row_map(texts, "_text", [T.StructField("grams", T.ArrayType(T.LongType()))], lambda: lambda c: [_arrays([_grams(t, size) for t in c.to_pylist()])], ["node"])
        parts.append(staged(sets, "simhash-sets"))
    discard(at)
    return parts


def ends_of(pairs: DataFrame) -> DataFrame:
    """node: all that are in a pair; a written table."""
    return staged(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "simhash-ends")


def alike(pairs: DataFrame, sets: DataFrame, permille: int) -> DataFrame:
    """a, b: of the pairs those whose sets are similar."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(shared * (1000 + permille) >= permille * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def differences(members: DataFrame, sets: DataFrame, permille: int) -> DataFrame:
    """``members`` (hub, n_hub, main, node, n, root) with ``close``, whether node and hub are similar, and ``tokens``: of the
    shingles that only one of them has, those of which another member must share one if it is similar; a written table.

    Let D be these shingles of a text, frequent ones of the hub's members last, and T = c (n_a + n_b) the most by which
    similar texts a, b differ: D_a and D_b share (|D_a| + |D_b| - T) / 2 or more. If both are close to the hub, they are
    connected. Else one, say a, isn't: |D_a| > c (n_a + n_hub), so they share more than (|D_b| + c (n_hub - n_b)) / 2,
    and in any case |D| - T of each. By prefix filtering, one of the first ``probes`` of D_a is one of the first ``indexes`` of D_b.
    """
    # Written first, so that Spark sees their sizes: of few, only their sets move.
    ids = [staged(members.select(F.col(c).alias("node")).distinct(), "simhash-ends") for c in ("hub", "node")]
    hubs = staged(sets.join(ids[0], "node", "left_semi").select(F.col("node").alias("hub"), F.col("grams").alias("of_hub")), "simhash-hubs")
    df = members.join(sets.join(ids[1], "node", "left_semi"), "node").join(hubs, "hub")
    df = df.withColumn("differ", F.concat(F.array_except("grams", "of_hub"), F.array_except("of_hub", "grams"))).drop("grams", "of_hub")
    d, less, more = F.size("differ"), 1000 - permille, 1000 + permille
    close = d * more <= less * (F.col("n") + F.col("n_hub"))
    # No text similar to one of n shingles differs from it in more than this.
    most = F.floor(less * F.col("n") / permille).cast("int")
    shared = F.floor((d * more + less * (F.col("n_hub") - F.col("n"))) / (2 * more)).cast("int") + 1
    probes = F.when((F.col("root") != F.col("main")) & ~close, d - F.greatest(F.lit(1), d - most) + 1).otherwise(0)
    df = df.select(*members.columns, "differ", d.alias("far"), close.alias("close"), probes.alias("probes"), (d - F.greatest(F.lit(1), d - most, shared) + 1).alias("indexes"))
    df = staged(df, "simhash-differences")
    discard(hubs, *ids)
    # Shingles of a part of the members, so that a hub has only a bounded number for each shingle of a difference.
    counts = df.select("hub", F.explode("differ").alias("g")).groupBy("hub", "g").agg(F.count(F.lit(1)).alias("m"))
    often = counts.join(df.groupBy("hub").agg(F.count(F.lit(1)).alias("all")), "hub").where(F.col("m") * OFTEN > F.col("all"))
    often = often.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("m", "g"))).alias("often")).select("hub", F.col("often.g").alias("often"))
    # The order is one for all members of a hub: by value, then those by their number.
    often = staged(often, "simhash-often")
    with_often = df.join(often, "hub", "left").withColumn("often", F.coalesce("often", F.array().cast("array<bigint>")))
    ordered = F.concat(F.array_except("differ", "often"), F.array_intersect("often", "differ"))
    out = staged(with_often.withColumn("tokens", F.slice(ordered, F.lit(1), F.greatest("probes", "indexes"))).drop("differ", "often"), "simhash-differences")
    discard(df, often)
    return out


def apart_pairs(crowd: DataFrame, sets: DataFrame, permille: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of pairs (a, b with sizes and places of a shared shingle) to compare, and of links (a, b): of ``crowd`` (token,
    node, n, at, root) all that are similar and have different roots are among the pairs or connected by the links.

    Of a crowd those outside its largest group must meet all others. Where that makes more than MANY pairs for each
    shingle of the texts, all are set against one text of the largest group instead, and what differs from it takes the place of the
    texts: near copies differ from it in few shingles, and two that aren't near it must share more than half of one's.
    Shingles of these differences that are again too frequent are treated the same with a text that has them.
    """
    pairs, links, last = [], [], None
    # The text with most shingles in crowds has fewest of its own; after that the one that differs least.
    far = crowd.groupBy("node").agg((-F.count(F.lit(1))).cast("int").alias("far"))
    crowd = crowd.join(far, "node").withColumn("probe", F.lit(None).cast("boolean")).withColumn("index", F.lit(True))
    # Of so many shingles or differences, those from the shared one on.
    crowd = crowd.withColumn("size", F.col("n")).withColumn("left", F.col("n") - F.col("at")).drop("at")
    side = lambda x, *more: [F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in ["node", "n", "size", "left", "root", *more]]
    for level in range(LEVELS):
        roots = crowd.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
        main = staged(roots.groupBy("token").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("token", "main"), "simhash-main")
        apart = staged(crowd.join(main, "token").withColumn("probe", F.coalesce("probe", F.col("root") != F.col("main"))), "simhash-apart")
        discard(last, main)
        wide = hubs = members = None
        if level < LEVELS - 1:
            hubs = apart.where("root = main").groupBy("token").agg(F.min_by(F.struct("node", "n"), F.struct("far", "node")).alias("hub"))
            counts = apart.groupBy("token").agg((F.count_if("probe") * F.count_if("index")).alias("pairs"))
            hubs = staged(hubs.join(counts, "token").select("token", F.col("hub.node").alias("hub"), F.col("hub.n").alias("n_hub"), "pairs"), "simhash-hubs")
            members = staged(apart.join(hubs, "token").select("hub", "n_hub", "main", "node", "n", "root").distinct(), "simhash-members")
            wide = hubs.groupBy("hub").agg(F.sum("pairs").alias("pairs")).join(members.groupBy("hub").agg(F.sum("n").alias("n")), "hub")
            wide = staged(wide.where(F.col("pairs") > MANY * F.col("n")).select("hub"), "simhash-wide")
            if wide.isEmpty():
                discard(wide)
                wide = None
            else:
                some = staged(apart.join(hubs.join(wide, "hub", "left_anti").select("token"), "token", "left_semi"), "simhash-apart")
                discard(apart)
                apart = some
        # Pairs that would come both ways come once, and only where enough is left to share.
        across = apart.where("probe").select("token", *side("a", "index")).join(apart.where("index").select("token", *side("b", "probe")), "token")
        across = across.where("root_a <> root_b AND NOT (index_a AND probe_b AND a > b)")
        across = across.where(F.least("left_a", "left_b") * 2 * (1000 + permille) >= (F.col("size_a") + F.col("size_b")) * (1000 + permille) - (F.col("n_a") + F.col("n_b")) * (1000 - permille))
        pairs.append(staged(across.select("a", "n_a", F.lit(0).alias("at_a"), "b", "n_b", F.lit(0).alias("at_b")).distinct(), "simhash-across"))
        discard(apart, hubs)
        if wide is None:
            discard(members)
            break
        found = differences(members.join(wide, "hub", "left_semi"), sets, permille)
        discard(members, wide)
        links.append(staged(found.where("close AND root <> main").select(F.col("node").alias("a"), F.col("hub").alias("b")), "simhash-close"))
        root = F.when(F.col("close"), F.col("main")).otherwise(F.col("root")).alias("root")
        rows = found.select("hub", "node", "n", root, "far", "probes", "indexes", F.posexplode("tokens").alias("place", "gram"))
        place = F.col("place")
        rows = staged(rows.select(F.xxhash64("hub", "gram").alias("token"), "node", "n", F.col("far").alias("size"), (F.col("far") - place).alias("left"), "root", "far", (place < F.col("probes")).alias("probe"), (place < F.col("indexes")).alias("index")), "simhash-rows")
        both = rows.groupBy("token").agg(F.max("probe").alias("p"), F.max("index").alias("i"), F.min("root").alias("low"), F.max("root").alias("high")).where("p AND i AND low <> high")
        crowd = last = staged(rows.join(both.select("token").hint("merge"), "token"), "simhash-crowd")
        discard(found, rows)
    return pairs, links


def similar_links(docs: DataFrame, nodes: DataFrame, size: int, permille: int, slices: int = SLICES) -> DataFrame:
    """a, b: links of fingerprints whose texts' sets of shingles have a Jaccard similarity of ``permille`` / 1000 or more, enough to connect all that are linked.

    By prefix filtering: with all shingles in one order, rare ones first, two similar sets share one of their
    first n - ceil(s n) + 1. Texts that share one are compared unless links found before connect them. The texts of a
    shingle that more than CROWD share are first compared with one of them, which changes by round and is the same for
    all shingles that it has, so that a group of near copies meets one text, not one for each shingle, and is
    connected without being compared pair by pair. After the rounds all pairs that are still apart are compared, of
    large crowds those that `apart_pairs` leaves.
    """
    own = lambda x: [F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("at").alias(f"at_{x}")]
    parts = []
    for i in range(slices):
        rows = nodes.select("node", "n", F.posexplode("prefix").alias("at", "token")).where(F.pmod("token", F.lit(slices)) == i)
        shared = staged(rows.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token", (F.col("m") > CROWD).alias("crowd")), "simhash-tokens")
        parts.append(staged(rows.join(shared.hint("merge"), "token"), "simhash-shared"))
        discard(shared)
    rows = reduce(DataFrame.unionByName, parts)
    # The rounds only go through the rows of crowds; ``root`` is the smallest node that a row's is connected with.
    crowd = staged(rows.where("crowd").select("token", "node", "n", "at", F.col("node").alias("root")), "simhash-crowd")

    def possible(pairs: DataFrame) -> DataFrame:
        """Of a, b with sizes and places of a shared shingle: those with shingles enough after it, the smaller first."""
        least = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        enough = pairs.where(least * (1000 + permille) >= permille * (F.col("n_a") + F.col("n_b")))
        n = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
        return enough.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), n("n_a", "n_b").alias("n_a"), n("n_b", "n_a").alias("n_b")).distinct()

    grouped, sets, whole = None, None, []
    for turn in range(ROUNDS):
        hub = F.min_by(F.struct("node", "n", "at", "root"), F.struct(F.xxhash64(F.lit(turn), "node"), F.col("node"))).alias("hub")
        hubs = crowd.groupBy("token").agg(hub, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        hubs = staged(hubs.select("token", *[F.col(f"hub.{c}").alias(x) for c, x in zip(["node", "n", "at", "root"], ["b", "n_b", "at_b", "root_b"])]), "simhash-crowds")
        if hubs.isEmpty():
            break
        if sets is None:
            # What the rounds compare is taken out of all texts once.
            ends = staged(crowd.join(hubs.select("token"), "token", "left_semi").select("node").distinct(), "simhash-ends")
            inside = staged(nodes.select("node", "bits", "whole").join(ends, "node", "left_semi"), "simhash-inside")
            whole = sets_of(docs, nodes, ends, size, slices)
            sets = reduce(DataFrame.unionByName, whole)
        pairs = staged(possible(crowd.select("token", *own("a"), F.col("root").alias("root_a")).join(hubs, "token").where("root_a <> root_b")), "simhash-pairs")
        some = staged(compared(pairs, inside, permille), "simhash-compared")
        # Few pairs are left open as a rule: then only their sets move.
        open_ends = ends_of(some.where("NOT sure"))
        told = alike(some.where("NOT sure"), sets.join(open_ends, "node", "left_semi"), permille)
        links = staged(some.where("sure").select("a", "b").unionByName(told), "simhash-alike")
        discard(hubs, pairs, some, open_ends)
        if links.isEmpty():
            break
        before, last = grouped, crowd
        grouped = components(links if before is None else links.unionAll(before.where("node <> root").select("node", "root")))
        crowd = staged(last.drop("root").join(grouped, "node", "left").select("token", "node", "n", "at", F.coalesce("root", "node").alias("root")), "simhash-crowd")
        discard(links, before, last)
    met, near = ([], []) if sets is None else apart_pairs(crowd, sets, permille)
    discard(crowd)
    few = rows.where("NOT crowd")
    few = few.select("token", *own("a")).join(few.select("token", *own("b")), "token").where("a < b")
    rest = staged(possible(reduce(DataFrame.unionByName, met, few.drop("token"))), "simhash-pairs")
    discard(*parts, *met, *whole)
    if sets is not None:
        discard(ends, inside)
    if grouped is not None:
        root = lambda x: grouped.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        rest = rest.join(root("a"), "a", "left").join(root("b"), "b", "left").where("coalesce(root_a <> root_b, true)").select("a", "b", "n_a", "n_b")
    rest = staged(compared(rest, nodes, permille), "simhash-compared")
    edges = reduce(DataFrame.unionByName, near, rest.where("sure").select("a", "b"))
    if grouped is not None:
        edges = edges.unionAll(grouped.where("node <> root").select("node", "root"))
    unsure = rest.where("NOT sure")
    if not unsure.isEmpty():
        sets = reduce(DataFrame.unionByName, sets_of(docs, nodes, ends_of(unsure), size, slices))
        edges = edges.unionByName(alike(unsure, sets, permille))
    fp = lambda x: nodes.select(F.col("node").alias(x), F.col("fp").alias(f"fp_{x}"))
    return edges.join(fp("a"), "a").join(fp("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).where("a <> b")


def keep(docs: DataFrame, size: int = KEEP_SHINGLE, permille: int = KEEP_PERMILLE) -> DataFrame:
    """One row of each component, of those with the smallest doc_id: of fingerprints within RADIUS bits, and of texts
    whose sets of ``size`` words have a Jaccard similarity of ``permille`` / 1000 or more.

    Rows are told by two hashes of doc_id and text. What is kept grows with the documents, so it is never
    broadcast: the texts are shuffled once, whatever the size. Repeated rows are collapsed before they move.
    """
    spark = docs.sparkSession
    k = [F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("_k2")]
    bounded_batches(spark)
    with bounded_broadcasts(spark), staging(spark) as result:
        common = _common(docs, size)
        slim = row_map(docs.select("doc_id", *k, as_bytes(F.col("text")).alias("_text")), "_text", _PROFILE_FIELDS, lambda: _profiles(common, size, permille), ["doc_id", "_k1", "_k2"])
        slim = staged(slim, "simhash-slim")
        marked = result(slim.select("doc_id", "_k1", "_k2", "fp"), "simhash-marked")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"))).alias("d")
        slices = min(SLICES, 1 + (slim.agg(F.sum("n")).first()[0] or 0) // SLICE)
        parts = []
        for i in range(slices):
            mine = slim.where(F.pmod("node", F.lit(slices)) == i).groupBy("node").agg(least, F.first(F.struct("_k1", "_k2", *[c for c in _PROFILE if c != "node"])).alias("s"))
            parts.append(staged(mine.select("node", "d", "s.*"), "simhash-nodes"))
        nodes = reduce(DataFrame.unionByName, parts)
        unstaged(slim)
        more = result(similar_links(docs.select("text", *k), nodes, size, permille, slices), "simhash-similar")
    with bounded_broadcasts(spark), staging(spark) as result:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2")))
        kept = result(classes(marked, more=more).groupBy("root").agg(first.alias("s")).select(F.col("s.k1").alias("_k1"), F.col("s.k2").alias("_k2")), "simhash-kept")
        again = result(marked.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_k1", "_k2"), "simhash-again")
    rows = packed(docs, *k)
    if again.isEmpty():
        return unpacked(rows.join(kept.hint("merge"), ["_k1", "_k2"], "left_semi"), docs.columns)
    once = rows.join(kept.join(again, ["_k1", "_k2"], "left_anti").hint("merge"), ["_k1", "_k2"], "left_semi")
    many = rows.join(kept.join(again, ["_k1", "_k2"], "left_semi").hint("merge"), ["_k1", "_k2"], "left_semi")
    one = many.groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"))
    return unpacked(once.select("_row").unionAll(one.select("_row")), docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
