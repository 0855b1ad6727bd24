"""Clashing names, long texts, repeated items and ties: what operators state for them."""

from __future__ import annotations

import hashlib
import random
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from gridloom.llm import bpe, chat, decontaminate, language, lengths, quality, sharding, simhash, warc
from gridloom.llm.common import fresh_path, staging
from pyspark.sql import functions as F
from test_operators import DE, EN, SCHEMA, SF, brute_hits, by_id, norm_words

#: Names that operators add or use inside.
CLASHES = ["N_Tokens", "_text", "_row", "_k1", "_k2", "_n_words", "n_words", "_new", "_cut", "_gone", "_first", "_lang_pred", "lang_pred", "score", "_host", "host", "failures", "kept", "fp", "node", "root", "_fp", "spans", "items", "_file", "_block", "_at", "_key", "shard", "slot", "size", "payload", "_digest", "_bytes", "refers_to", "ids", "offsets", "decodes", "component_id", "_long", "_n"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, EN, "en", "a", 1), (1, EN, "en", "a", 1), (2, DE, "de", "b", 2), (3, None, None, None, None), (4, "", "en", "a", 0), (5, EN + " one two three four five six seven eight nine ten eleven", "en", "a", 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, n in enumerate(CLASHES):
        df = df.withColumn(n, F.concat(F.lit(f"{i}-"), F.col("doc_id")))
    return df


def same(df, clashing, replaced=()):
    """Columns that aren't replaced come back as they were."""
    mine = {n for n in df.columns if n in CLASHES and n.lower() not in {r.lower() for r in replaced}}
    for r in df.collect():
        for n in mine:
            assert r[n] == f"{CLASHES.index(n)}-{r['doc_id']}", n


@pytest.mark.parametrize("name", ["quality", "language", "simhash", "decontaminate", "decontaminate blocks"])
def test_keep_returns_all_columns(spark, clashing, name):
    items = spark.createDataFrame([("i", "one two three four five six seven eight nine ten eleven"), ("j", "alpha beta gamma")], "item_id string, text string")
    make = {
        "quality": lambda d: quality.keep(d, quality.Rules(min_words=3)),
        "language": language.keep,
        "simhash": simhash.keep,
        "decontaminate": lambda d: decontaminate.keep(d, items),
        "decontaminate blocks": lambda d: decontaminate.keep(d, items, block_words=5),
    }
    out = make[name](clashing)
    assert out.columns == clashing.columns and out.count() > 0
    same(out, clashing)
    if "decontaminate" in name:
        assert by_id(out)[5][0]["text"].strip() == EN and by_id(out)[5][0]["n_chars"] == len(EN) + 1


def test_operators_replace_only_their_own_columns(spark, clashing):
    same(quality.apply(clashing), clashing, [*quality.MEASURES, "base_failed", "failures", "kept"])
    got = by_id(quality.apply(clashing))
    assert got[1][0]["n_words"] == len(EN.split()) and got[2][0]["kept"] is True
    same(language.predict(clashing, language.train(clashing)), clashing, ["lang_pred", "score"])
    for df, own in ((bpe.round_trip(clashing), ["n_tokens"]), (bpe.with_ids(clashing), ["ids", "offsets"]), (bpe.encoded(clashing), ["ids", "decodes"]), (bpe.token_counts(clashing), ["n_tokens"])):
        same(df, clashing, own)
        assert len(df.columns) == len({c.lower() for c in df.columns}) and df.count() == 6
    assert all(isinstance(r["n_tokens"], int) for r in bpe.round_trip(clashing).collect())
    same(sharding.apply(clashing), clashing, ["size", "text_crc32", "shard", "slot"])
    items = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    same(decontaminate.hits(clashing, items), clashing, ["n_words", "spans", "items"])
    same(decontaminate.hits(clashing, items.unionAll(spark.createDataFrame([("j", "four five")], items.schema)), block_words=1), clashing, ["n_words", "spans", "items"])
    pages = clashing.withColumn("page_id", F.col("doc_id")).withColumn("url", F.lit("http://x/")).withColumn("html", F.repeat("text", 20))
    planned = warc.plan(pages)
    same(planned, clashing, warc.PLANNED)
    records = warc.records(warc.write(planned, fresh_path(spark, "warc-clash"))).collect()
    assert Counter(r["record_type"] for r in records) == {"response": 6}
    assert {r["doc_id"] for r in simhash.apply(clashing).collect()} == {1, 2, 3, 4, 5}


# Benchmark items

def test_repeated_items_count_once(spark):
    items = spark.createDataFrame([(7, "a b c"), (7, "a b c"), (7, "c d e"), (None, "x y"), (None, "z z"), (8, "q")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x y z z"), (3, "n"), (4, "q A-b C")], "doc_id long, text string")
    for block_words in (1, 4, 10**6):
        got = by_id(decontaminate.hits(docs, items, block_words=block_words))
        assert [got[i][0]["items"] for i in (1, 2, 3, 4)] == [["7"], [""], [], ["7", "8"]]
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas().astype({"item_id": "Int64"}))
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_items, items_sha256 FROM ({decontaminate.SQL})").fetchall()}
    for i, r in by_id(decontaminate.hits(docs, items)).items():
        assert want[i] == (len(r[0]["items"]), hashlib.sha256(",".join(r[0]["items"]).encode()).hexdigest())


def test_cuts_of_many_blocks_equal_those_of_one(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 30])))) for i in range(10)], "item_id long, text string")
    passages = [r["text"] for r in items.collect()]
    texts = [" ".join([rng.choice(words) for _ in range(rng.randrange(5, 60))] + rng.choice(passages).split()[: rng.randrange(1, 31)] + [rng.choice(words) for _ in range(30)]) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(100, None, None, None, None), (101, texts[0], "en", "a", 0)], SCHEMA)
    one = sorted(map(repr, decontaminate.keep(docs, items).collect()))
    assert one == sorted(map(repr, decontaminate.keep(docs, items, block_words=20).collect()))
    assert 0 < len(one) and all(brute_hits(r["text"], [(str(i), p) for i, p in enumerate(passages)])[1] == 0 for r in decontaminate.keep(docs, items).collect())


# Host verdicts

def hosts(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        host = ["good", "bad", "mixed", None][i % 4]
        fails = rng.random() < {"good": 0.05, "bad": 0.9, "mixed": 0.4, None: 0.9}[host]
        words = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(40)]
        rows.append((i, " ".join(words[:5] if fails else words), "en", host, 1))
    return spark.createDataFrame(rows, SCHEMA)


def test_a_rejected_host_takes_its_good_documents(spark):
    docs = hosts(spark)
    rates = {r["host"]: r for r in quality.host_rates(quality.judge(quality.measure(docs))).collect()}
    assert {h for h, r in rates.items() if r["host_rejected"]} == {"bad"}
    got = by_id(quality.apply(docs))
    good = {r["doc_id"] for r in docs.collect() if len(r["text"].split()) >= 20}
    lost = {i for i in good if got[i][0]["source"] == "bad"}
    assert lost and {i for i in got if got[i][0]["kept"]} == good - lost and {i for i in good if got[i][0]["source"] is None} - lost
    assert {r["doc_id"] for r in quality.keep(docs).collect()} == good - lost
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(f"SELECT doc_id, kept FROM ({quality.SQL})").fetchall()
    assert {i: k for i, k in want} == {i: r[0]["kept"] for i, r in got.items()}


# Languages

def brute_vector(text, size=language.DIMENSIONS, seed=7):
    letters = [c if c.isalpha() else " " for c in f" {(text or '').lower()} "]
    symbols = [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
    v = lambda c: language.letter_vector(ord(c) if c != " " else 0, seed, size).astype(int)
    out = np.zeros(size, dtype=int)
    for (a, b, c), n in Counter(zip(symbols, symbols[1:], symbols[2:])).items():
        out += n * np.roll(v(a), 2) * np.roll(v(b), 1) * v(c)
    return out


def test_languages_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    vectors = {r["doc_id"]: brute_vector(r["text"]) for r in docs}
    import zlib

    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    names = sorted({r["lang"] for r in docs if r["lang"]})
    proto = {n: sum(np.rint(vectors[r["doc_id"]] * (65536 / max(np.linalg.norm(vectors[r["doc_id"]]), 1))) for r in docs if r["lang"] == n and not held[r["doc_id"]]) for n in names}
    got = by_id(language.op3_language_id(spark, SF))
    for i, v in vectors.items():
        r = got[i][0]
        cosine = [v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-12) for p in proto.values()]
        want = names[int(np.argmax(cosine))] if v.any() else "und"
        assert (r["held_out"], r["lang_pred"]) == (held[i], want) and r["score"] == pytest.approx(max(max(cosine), 0) if v.any() else 0)


def test_equal_cosines_give_the_first_language(spark):
    docs = spark.createDataFrame([(EN, "b"), (EN, "a"), (EN, "c")], "text string, lang string")
    assert {r["lang_pred"] for r in language.predict(docs, language.train(docs)).collect()} == {"a"}


def test_a_long_text_of_many_letters_needs_little_memory():
    """2 MB of mixed CJK letters, some 700,000 different trigrams, in a process of its own."""
    code = """
import random, resource
from gridloom.llm import language
rng = random.Random(1)
text = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(700_000)).encode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
v = language.vectors([text, b"abc"], 7, language.DIMENSIONS)
assert v[0].any() and v[1].any()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 400


def test_segments_cover_a_text():
    rng = random.Random(3)
    for unit in (" wörd", "字", "a"):
        text = (unit * (language.SEGMENT // len(unit.encode()) * 3 + rng.randrange(9))).encode()
        parts = list(language.segments(text))
        assert b"".join(parts) == text and len(parts) > 2 and all(len(p) <= language.SEGMENT for p in parts)
        assert [p.decode() for p in parts]


# Lengths

def test_quantiles_are_exact(spark):
    for n in (1, 3, 10, 11):
        sums = lengths.suffix_sums(lengths.histogram(spark.range(n).withColumnRenamed("id", "n_tokens"))).persist()
        for q in [i / 20 for i in range(1, 21)] + [1 / n]:
            # The smallest length that a share q or more of 0..n-1 doesn't exceed; q as it is written.
            from fractions import Fraction

            want = next(x for x in range(n) if Fraction(x + 1, n) >= Fraction(str(q)))
            assert lengths.quantile(sums, q).first()[0] == want, (n, q)
    assert lengths.quantile(sums.limit(0), 0.5).first()[0] is None
    assert lengths.at_limits(sums.limit(0), [1, 2]).count() == 0
    late = lengths.suffix_sums(lengths.histogram(spark.createDataFrame([(5,), (9,)], "n_tokens long")))
    assert {tuple(r) for r in lengths.at_limits(late, [2, 5, 7, 20]).select("limit", "truncated_tokens", "docs_longer").collect()} == {(2, 4, 2), (5, 10, 1), (7, 12, 1), (20, 14, 0)}


# Chat

def test_text_conversation_numbers(spark):
    rows = [("a", "1", "user", "hi"), ("b", "1", "user", "hi"), ("b", "2", "assistant", "yes"), ("c-9", "10", "user", "late"), ("c-9", "9", "user", "early"), (None, "x", "user", "odd")]
    got = chat.apply(spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")).collect()
    kept = {}
    for r in sorted(got, key=lambda r: r["position"]):
        kept.setdefault(r["conv_id"], []).append(r["rendered"].split("\n")[1].removesuffix("<|im_end|>"))
    assert kept == {"b": ["hi", "yes"], "c-9": ["early", "late"], None: ["odd"]}


def test_a_long_conversation_lies_in_many_blocks(spark):
    # Turns without a number and a null conversation: 4,000 rows each; the longer log has the shorter as its prefix.
    turns = [(c, f"t{i:05d}", "user", f"x{i}") for c, n in (("long", 4000), ("short", 2500), (None, 4000)) for i in range(n)]
    turns += [("other", str(i), "user", f"y{i}") for i in range(-300, 5)]
    df = spark.createDataFrame(turns, "conv_id string, turn string, role string, text string")
    with staging(spark):
        rolled = chat.prefixes(df)
        assert {tuple(r) for r in rolled.groupBy("conv_id").agg({"position": "max"}).collect()} == {("long", 3999), ("short", 2499), (None, 3999), ("other", 304)}
        assert rolled.where("conv_id = 'other' AND position = 0").first()["turn"] == "-300"
    got = {r["conv_id"]: (r["n"], r["logs"]) for r in chat.apply(df).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_logs").alias("logs")).collect()}
    assert got == {"long": (4000, 2), "other": (305, 1)}
    sizes = chat.blocked(df).groupBy("block").count()
    assert sizes.agg(F.max("count")).first()[0] <= chat.BLOCK


# Tokens

def test_offsets_decode(spark):
    docs = spark.createDataFrame([(1, "Hello wörld 字字 don't  \n x"), (2, ""), (3, None), (4, "a" * 5000)], "doc_id long, text string")
    e = bpe.encoder(bpe.default_path())
    for r in bpe.with_ids(docs.withColumn("copy", F.col("text"))).collect():
        raw = (r["copy"] or "").encode()
        cuts = [*r["offsets"], len(raw)]
        assert [raw[a:b] for a, b in zip(cuts, cuts[1:])] == [e.bytes_of[i] for i in r["ids"]]


# Sharding

def test_shards_are_the_smallest_possible(spark):
    """The capacity by plain dynamic programming over the ordered groups."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 3, 40, 300]))) for _ in range(70)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    size = {}
    for t in texts:
        size[t] = size.get(t, 0) + len(t.encode()) + 1
    ordered = [size[t] for t in sorted(size, key=lambda t: hashlib.sha256(t.encode()).hexdigest())]
    total = np.concatenate(([0], np.cumsum(ordered)))
    for k in (1, 3, 16):
        best = [0] + [10**9] * len(ordered)
        for _ in range(k):
            best = [0] + [min(max(best[j], int(total[i] - total[j])) for j in range(i)) for i in range(1, len(ordered) + 1)]
        loads = Counter()
        for r in sharding.apply(docs, k=k).collect():
            loads[r["shard"]] += r["size"]
        assert max(loads.values()) == best[-1]


def test_words_of_this_module():
    assert norm_words("A-b_c") == ["a", "b", "c"]
