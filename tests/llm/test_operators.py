"""The corpus operators on small cases: nulls, blanks, long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import accumulate

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, decontaminate, language, lengths, quality, registry, sharding, simhash, warc
from gridloom.llm.common import fresh_path, staging

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals in this wide green field today"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft heute weit weg von allen anderen tieren auf diesem großen feld"


@pytest.fixture(scope="module")
def docs(spark):
    long_text = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, EN, "en", "a", 1), (2, EN, "en", "a", 1), (2, EN, "en", "a", 1), (3, None, "en", "a", None), (4, "", None, "a", 0), (5, " \n\t ", "en", None, 4),
        (6, DE, "de", "b", 1), (7, long_text, "en", "b", 1), (8, "### $$$ " * 30, "en", "b", 1), (9, "12345 67", "en", None, 8), (None, EN + " extra", "en", "b", 1),
        (10, "short text", "en", "b", 1), (11, ("again and again " * 30).strip(), "en", "b", 1), (12, EN.replace("quick", "slow"), None, "b", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def norm_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# Quality

def brute_measures(text):
    w, text = words(text), text or ""
    seen, hit = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {j for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark, docs):
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = quality.measure(docs.withColumn("N_Words", F.lit(0)).withColumn("t2", F.col("text"))).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measures(r["t2"])
    assert texts


def test_repeat_words_random():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    own = [t.encode().split() for t in texts]
    got = quality.repeat_words([w for t in own for w in t], np.array([len(t) for t in own]))
    assert got.tolist() == [brute_measures(t)[5] for t in texts]


def test_quality_hosts(spark, empty):
    rows = [(i, "x", None, "good", 1, [] if i % 10 else ["short"]) for i in range(100)] + [(i, "x", None, "bad", 1, [] if i % 4 == 0 else ["repeats"]) for i in range(200, 260)] + [(900, "x", None, "rare", 1, ["short"]), (901, "x", None, None, 1, [])]
    judged = spark.createDataFrame(rows, SCHEMA + ", failures array<string>")
    rates = {r["host"]: r for r in quality.host_rates(judged).collect()}
    assert rates["bad"]["host_rejected"] and not rates["good"]["host_rejected"]
    a, b = quality.prior(3, 161, 56, 10 * 0.1 + 45 * 0.75 + 1.0)
    for h, (n, f) in {"good": (100, 10), "bad": (60, 45), "rare": (1, 1)}.items():
        assert rates[h]["host_rate"] == pytest.approx((f + a) / (n + a + b))
    kept = by_id(quality.verdicts(judged, rules=quality.Rules()))
    assert not kept[200][0]["kept"] and kept[1][0]["kept"] and not kept[0][0]["kept"] and kept[901][0]["kept"]
    assert quality.apply(empty).count() == 0 and quality.prior(0, 0, 0, 0) == (1.0, 1.0)


def test_quality_keep(spark, docs, empty):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 6} and not {3, 4, 5, 8, 10, 11} & {r["doc_id"] for r in kept.collect()}
    assert quality.keep(empty).count() == 0


# Decontamination

def brute_hits(text, items):
    w, hit, found = norm_words(text), set(), []
    for name, item in items:
        v = norm_words(item)
        k = min(10, len(v))
        wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        at = [i for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in wins] if v else []
        if at:
            found.append(name)
            hit |= {j for i in at for j in range(i, i + k)}
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [1, 25, 10**6])
def test_decontamination_random(spark, block_words):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(str(i), text(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 12, 25]))) for i in range(12)] + [("same", "a b c d a"), ("again", "A, b; c d a!")]
    texts = [None, "", *[text(rng.randrange(0, 120)) for _ in range(40)]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    for r in decontaminate.hits(d, b, block_words=block_words).collect():
        n, hit, found = brute_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], sum(y - x for x, y in r["spans"]), r["items"]) == (n, hit, found)


@pytest.mark.parametrize("block_words", [15, 10**6])
def test_decontamination_cuts(spark, docs, empty, block_words):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu")], "item_id long, text string")
    extra = spark.createDataFrame([(50, f"{EN} {passage.upper()} {EN}", "en", "z", 7), (51, passage, "en", "z", 7), (52, "one two three four five alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu six seven eight nine ten " + EN + EN, "en", "z", 7)], SCHEMA)
    kept = by_id(decontaminate.keep(docs.unionByName(extra), items, block_words=block_words))
    assert 51 not in kept and words(kept[50][0]["text"]) == words(EN) * 2 and kept[50][0]["n_chars"] == len(kept[50][0]["text"])
    assert brute_hits(kept[52][0]["text"], [("1", passage)])[1] == 0
    assert kept[1][0]["text"] == EN and kept[1][0]["n_chars"] == 1 and len(kept[2]) == 2 and kept[3][0]["text"] is None
    assert decontaminate.keep(docs, items.limit(0)).count() == docs.count() and decontaminate.keep(empty, items).count() == 0


# Language

def test_language(spark, docs, empty):
    model = language.train(docs)
    assert model.languages == ["de", "en"]
    got = by_id(language.predict(docs.withColumn("Score", F.lit(1)), model))
    assert got[6][0]["lang_pred"] == "de" and got[12][0]["lang_pred"] == "en"
    for i in (3, 4, 5, 8, 9):
        assert (got[i][0]["lang_pred"], got[i][0]["score"]) == ("und", 0.0)
    assert all(0 <= r[0]["score"] <= 1 for r in got.values())
    assert language.train(empty).languages == [] and language.predict(docs, language.train(empty)).where("lang_pred <> 'und'").isEmpty()
    kept = language.keep(docs)
    assert kept.columns == docs.columns and not {3, 4, 5, 9} & {r["doc_id"] for r in kept.collect()}


def test_language_vectors_are_bound_and_bundled():
    points, text, tri = language.trigrams([b"Ab-c", b"", b"1"])
    assert [[chr(c) if c else " " for c in points[t]] for t in tri] == [[" ", "a", "b"], ["a", "b", " "], ["b", " ", "c"], [" ", "c", " "]] and set(text) == {0}
    v = lambda c: language.letter_vector(ord(c) if c != " " else 0, 7, 64).astype(int)
    want = sum(np.roll(v(a), 2) * np.roll(v(b), 1) * v(c) for a, b, c in ((" ", "a", "b"), ("a", "b", " "), ("b", " ", "c"), (" ", "c", " ")))
    assert (language.bundle(text, tri, points, 3, 7, 64)[0] == want).all()


def test_language_held_out(spark):
    got = language.op3_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())


# Sharding

def test_sharding(spark, docs, empty):
    rows = sharding.apply(docs.withColumn("Shard", F.lit("x"))).collect()
    truth = {}
    for r in docs.collect():
        truth.setdefault(r["text"] or "", 0)
        truth[r["text"] or ""] += len((r["text"] or "").encode()) + 1
    keyed = {hashlib.sha256(t.encode()).hexdigest(): n for t, n in truth.items()}
    order = sorted(keyed)
    sizes = [keyed[k] for k in order]
    # The smallest capacity, by trying all.
    capacity = next(c for c in sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}) if sharding.greedy(list(accumulate(sizes)), c, 16))
    loads = {}
    for r in rows:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert len(rows) == docs.count() and max(loads.values()) == capacity
    for s in loads:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(EN.encode())}) == 1
    assert sharding.apply(empty).count() == 0


def test_sharding_is_exact():
    rng = random.Random(11)
    for trial in range(150):
        n, k = rng.choice([1, 2, 30, 400]), rng.choice([1, 3, 16])
        size = rng.choice([lambda: 1, lambda: rng.randint(1, 30), lambda: int(rng.paretovariate(1.1) * 10)])
        groups = {hashlib.sha256(f"{trial}-{i}".encode()).hexdigest()[:6]: size() for i in range(n)}
        keys = sorted(groups)

        def ranges(digits, inside=None):
            found = {}
            for key in keys:
                if inside is None or any(key.startswith(p) for p in inside):
                    r = found.setdefault(key[:digits], [0, 0])
                    r[0] += groups[key]
                    r[1] += 1
            return found

        atoms, digits = [(p, *v) for p, v in ranges(1).items()], 1
        while True:
            todo = sharding.open_ranges([a[1] for a in atoms], [a[2] == 1 for a in atoms], max(groups.values()), k)[0]
            if not todo:
                break
            digits += 1
            inner = [(p, *v) for p, v in ranges(digits, [atoms[i][0] for i in todo]).items()]
            atoms = sorted([a for i, a in enumerate(atoms) if i not in set(todo)] + inner)
        assert sharding.smallest([a[1] for a in atoms], k) == sharding.smallest([groups[x] for x in keys], k)


# WARC

def test_warc(spark):
    big, small = "ä" * 150_000 + "\r\n\r\nWARC/1.1\r\n", "x" * 999
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "y" * 1000), (8, "u", "y" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(warc.plan(pages), fresh_path(spark, "warc-test"))
    got = sorted((tuple(r) for r in warc.records(manifest).collect()), key=repr)
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = []
    for p, _, h in rows:
        again = h == big and p != 3
        want.append((p, len((h or "").encode()), sha(h), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=repr)
    chunks = warc.read(manifest).where("page_id = 3").orderBy("chunk").collect()
    assert len(chunks) > 3 and b"".join(r["data"] for r in chunks) == big.encode()
    run = hashlib.sha1()
    for r in chunks:
        run.update(r["data"])
        assert r["digest"] == run.hexdigest()
    assert warc.records(warc.write(warc.plan(pages.limit(0)), fresh_path(spark, "warc-none"))).count() == 0


# Tokens

@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(reference_encoding):
    e = bpe.encoder(bpe.default_path())
    rng = random.Random(2)
    bits = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "!", "…", " ", "　", "𝒳", "😀", "'s", "don't", "x" * 80, "\r\n", "\x1c", "\x85", "_", "<|endoftext|>"]
    texts = ["", *("".join(rng.choice(bits) for _ in range(rng.randrange(0, 20))) for _ in range(3000)), "ab" * 3000, " " * 500]
    got = e.encode([t.encode() for t in texts])
    for t, ids in zip(texts, got):
        assert ids == reference_encoding.encode_ordinary(t), t
        assert e.decode(ids) == t.encode() and e.offsets(ids)[-1] == len(t.encode())


def test_bpe_merges_of_long_slices_agree():
    e = bpe.encoder(bpe.default_path())
    rng = random.Random(4)
    for _ in range(100):
        piece = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 60))).encode()
        assert e.merge([piece])[0] == e.merge_long(piece)


def test_bpe_query(spark, docs, empty, reference_encoding):
    got = bpe.round_trip(docs.withColumn("N_Tokens", F.lit(0)).drop("N_Tokens"), keep=["doc_id", "text", "source"][::2])
    for r in got.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = reference_encoding.encode_ordinary(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert got.count() == docs.count() and bpe.round_trip(empty).count() == 0
    row = bpe.with_ids(docs.where("doc_id = 6"), keep=["doc_id"]).first()
    assert row["offsets"][0] == 0 and len(row["offsets"]) == len(row["ids"])


def test_lengths(spark, docs, empty):
    counts = [5, 5, 0, 2000, 3000, 3000, 7, 1]
    sums = lengths.suffix_sums(lengths.histogram(spark.createDataFrame([(c,) for c in counts], "n_tokens long"))).persist()
    for r in sums.collect():
        limit = r["n_tokens"]
        assert (r["n_docs"], r["docs_longer"], r["tokens_longer"], r["total_tokens"]) == (counts.count(limit), sum(c > limit for c in counts), sum(c for c in counts if c > limit), sum(counts))
        assert r["truncated_tokens"] == sum(min(c, limit) for c in counts) and r["lost_tokens"] == sum(counts) - r["truncated_tokens"]
        assert r["at_most_share"] == pytest.approx(sum(c <= limit for c in counts) / len(counts))
    for r in lengths.at_limits(sums, [0, 3, 6, 2500, 10**6]).collect():
        assert r["truncated_tokens"] == sum(min(c, r["limit"]) for c in counts) and r["docs_longer"] == sum(c > r["limit"] for c in counts)
    assert lengths.quantile(sums, 0.5).first()[0] == sorted(counts)[3]
    assert lengths.suffix_sums(lengths.histogram(bpe.token_counts(empty, keep=[]))).count() == 0
    assert lengths.histogram(bpe.token_counts(docs, keep=[])).agg(F.sum("n_docs")).first()[0] == docs.count()


def test_lengths_query(spark, reference_encoding):
    rows = lengths.op8_token_lengths(spark, SF).collect()
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    counts = [len(reference_encoding.encode_ordinary(t)) for t in texts]
    assert {r["n_tokens"]: r["n_docs"] for r in rows} == {c: counts.count(c) for c in set(counts)}


# Chat

def test_chat(spark):
    talk = lambda c, *t: [(c, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(t)]
    rows = talk(1, "hi", "hello") + talk(2, "hi", "hello", "more") + talk(3, "hi", "hello", "more") + talk(4, "hi", "other") + talk(5, "hi") + [(6, None, None, None)] + [(None, 0, "user", "lone")] + [(7, 0, "user", "twice")] * 3 + talk(8, "", "x") + [(9, 0, "user", None), (9, 1, "assistant", "x")] + talk(10, *[str(i) for i in range(700)]) + talk(11, *[str(i) for i in range(600)])
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("h1", F.lit(1))
    got = chat.apply(turns).collect()
    kept = {}
    for r in got:
        kept.setdefault(r["conv_id"], []).append((r["position"], r["n_turns"], r["n_logs"], r["rendered"]))
    assert set(kept) == {2, 4, 6, None, 7, 8, 9, 10}
    assert sorted(kept[2])[2] == (2, 3, 2, "<|im_start|>user\nmore<|im_end|>\n") and len(kept[7]) == 1 and len(kept[10]) == 700
    assert chat.apply(turns.limit(0)).count() == 0


# SimHash

def brute_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_fingerprints(docs, empty):
    for r in simhash.with_fingerprint(docs.withColumn("t2", F.col("text"))).collect():
        assert r["fp"] % (1 << 64) == brute_fingerprint(r["t2"])
    got = by_id(simhash.apply(docs))
    assert len(got[2]) == 2 and {got[i][0]["component_id"] for i in (1, 2)} == {1} and {got[i][0]["component_id"] for i in (3, 4, 5)} == {3}
    assert simhash.apply(empty).count() == 0
    kept = simhash.keep(docs)
    ids = sorted((r["doc_id"] or -1) for r in kept.collect())
    assert kept.columns == docs.columns and 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and len(ids) == len(set(ids))


def test_components_of_planted_fingerprints(spark):
    """Chains, stars and lone fingerprints at distances 0 to 6, against all pairs."""
    rng = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            y = x
            for j in rng.sample(range(64), rng.randrange(1, 7)):
                y ^= 1 << j
            fps.add(y)
            if rng.random() < 0.5:
                x = y
    fps = sorted(fps)
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[max(root(i), root(j))] = min(root(i), root(j))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    marked = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(signed)] + [(5000, signed[0])], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(marked).collect()}
    assert got == {**{1000 + i: 1000 + root(i) for i in range(len(fps))}, 5000: 1000 + root(0)}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# Queries with SQL

@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    assert got == sorted(repr(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert math.isclose(simhash.RADIUS, 3)


# Near copies by their texts

def test_keep_finds_similar_texts(spark):
    """Pairs around similarity 0.8 that fingerprints miss, and a crowd of near copies, against all pairs."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, chorus = [], " ".join(word() for _ in range(12))
    for copies in [2] * 20 + [60]:
        base = [word() for _ in range(150)]
        texts.append(" ".join([*base, chorus]))
        for _ in range(copies - 1):
            own = list(base)
            for i in rng.sample(range(150), rng.randrange(1, 7)):
                own[i] = word()
            texts.append(" ".join([*own, chorus]))
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    fps = [brute_fingerprint(t) for t in texts]
    label, missed = list(range(len(texts))), 0
    near = {(a, b) for b in range(len(texts)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            close = (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS
            missed += (a, b) in near and not close
            if close or (a, b) in near:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert missed > 10
    got = {r["doc_id"] for r in simhash.keep(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert {i for i in range(40) if label[i] == i} == {i for i in got if i < 40}
    assert {i for i in range(40, 100) if label[i] == i} <= got and not any(a in got and b in got for a, b in near)


def test_keep_follows_links_through_removed_texts(spark):
    """Crowds whose texts are similar to some of the others only, as a chain and as copies of copies: full components, by all pairs."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))

    def changed(base, n):
        own = list(base)
        for i in rng.sample(range(12, len(base)), n):
            own[i] = word()
        return own

    lists = [[word() for _ in range(150)]]
    for _ in range(59):
        lists.append(changed(lists[-1], 2))
    base = [word() for _ in range(150)]
    inner = [changed(base, 1) for _ in range(40)]
    lists += inner + [changed(x, 3) for x in inner[::2]]
    lists += [inner[0][:12] + [word() for _ in range(100)] for _ in range(10)]
    rng.shuffle(lists)
    texts = [" ".join(x) for x in lists]
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    fps = [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS or near(a, b):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    apart = sum(label[a] == label[b] and not near(a, b) for b in range(len(texts)) for a in range(b))
    assert apart > 100 and len(set(label)) == 12
    got = sorted(r["doc_id"] for r in simhash.keep(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)).collect())
    assert got == sorted(set(label))


@pytest.mark.parametrize("many", [None, 0])
def test_keep_of_a_large_group_compares_few_pairs(spark, monkeypatch, many):
    """Near copies of one text, some too far from it and from most others: full components by all pairs, without a comparison of each with each."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))

    def changed(base, n):
        own = list(base)
        for i in rng.sample(range(12, len(base)), n):
            own[i] = word()
        return own

    base = [word() for _ in range(150)]
    lists = [changed(base, rng.randrange(1, 4)) for _ in range(300)]
    far = [changed(base, rng.randrange(5, 12)) for _ in range(250)]
    other = changed(base, 6)
    far += [changed(other, rng.randrange(4, 8)) for _ in range(100)]
    lists += far + [changed(x, rng.randrange(1, 6)) for x in far[::5]]
    rng.shuffle(lists)
    texts = [" ".join(x) for x in lists]
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    fps = [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if label[a] != label[b] and ((fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    sizes = Counter(label).values()
    assert len(sizes) > 150 and max(sizes) > 250 and sum(n > 1 for n in sizes) > 30
    made, compared = [], simhash.compared

    def counted(pairs, nodes, permille):
        made.append(pairs.count())
        return compared(pairs, nodes, permille)

    monkeypatch.setattr(simhash, "compared", counted)
    if many is not None:
        # All levels, however few the pairs.
        monkeypatch.setattr(simhash, "MANY", many)
    got = sorted(r["doc_id"] for r in simhash.keep(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)).collect())
    assert got == sorted(set(label))
    # All pairs of different components are over 50,000.
    assert sum(made) < 20 * len(texts)


def test_common_shingles_sent_to_the_driver(spark, monkeypatch):
    """As many as wanted, not as many from each partition."""
    texts = [" ".join(f"{p}{i}" for i in range(60_000)) + f" {c}" for p in "ab" for c in range(5 if p == "a" else 4)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    conf = spark.sparkContext._jsc.sc().conf()
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    most = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "2m")
    try:
        often = set(simhash.shingle_hashes(texts[0].encode(), 5))
        for wanted in (70_000, 20_000):
            monkeypatch.setattr(simhash, "MOST_COMMON", wanted)
            with staging(spark):
                common = simhash._common(frame, 5)
            assert abs(len(common) - wanted) < 1000 and len(set(common.tolist())) == len(common)
            # Those of five texts come last, and before any of four.
            assert {int(g) % (1 << 64) for g in common[-min(wanted - 1000, 59_000) :]} <= often
    finally:
        conf.set("spark.driver.maxResultSize", most)
        for k, v in before.items():
            spark.conf.set(k, v)
