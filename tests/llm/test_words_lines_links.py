"""Spelling variants, tokenizer alignment and line dedup against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import alignment, lines, registry, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def documents(path=SF):
    return duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall()


# Spelling variants


def words_of(rows, noise=199, least=6, count=5):
    found = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def near_words(words):
    """By neighbourhoods of deletions: words one edit apart share the word or one of its deletions."""
    places = defaultdict(set)
    for w in words:
        for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            places[d].add(w)

    def one(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = defaultdict(set)
    for group in places.values():
        for a in group:
            near[a] |= {b for b in group if a != b and b not in near[a] and one(a, b)}
    return near


def variants_of(words, factor=5):
    near, form = near_words(words), {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= factor * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return out


def as_variants(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


@pytest.mark.parametrize("path", [SF, "/root/testdata/sf0.01"])
def test_spelling_variants_of_a_table(spark, path):
    got = as_variants(registry.queries()["op11_spelling_variants"](spark, path))
    assert len(got) == len(set(got)) and set(got) == variants_of(words_of(documents(path)))


def test_spelling_variants_of_near_words(spark):
    """Words over three letters, so that most have several near words of equal bigrams; chains of forms; accents."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        w = "".join(rng.choice("aabé") for _ in range(rng.randint(6, 9)))
        rows += [(i, " ".join([w] * rng.choice([5, 6, 30, 200])), "en")]
    rows += [(None, "Colour COLOUR colour's colourx " * 3, None), (None, None, None), (7, "", "en"), (7, "", "en"), (8, "中文 ×÷ 12", "zh"), (9, "aaaaaa" + "b" * 3000 + " ", "en")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit(1)).withColumn("n", F.lit("n"))
    for noise in (None, 3):
        got = as_variants(spelling.variants(spelling.vocabulary(docs, noise=noise, least_count=5)))
        assert len(got) == len(set(got)) and set(got) == variants_of(words_of([r[:2] for r in rows], noise))
        assert any(r[1] for r in got) and any(r[2] != (r[1] or r[0]) for r in got)


def test_no_words(spark):
    assert as_variants(spelling.variants(spelling.vocabulary(spark.createDataFrame([], SCHEMA)))) == []
    assert as_variants(spelling.variants(spelling.vocabulary(spark.createDataFrame([(1, None, "en"), (2, "", None)], SCHEMA)))) == []


def test_rarest_bigrams_come_first():
    ranks = {"ab": 5, "bc": 0, "cd": 2, "da": 1}
    assert spelling.rarest("abcdab", ranks) == [1, 3, 2]


# Alignment


@pytest.fixture(scope="module")
def coders():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(text, coders):
    a, b = coders
    if not text:
        return [], [], "", []
    value = alignment.byte_values()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], [], "", []
    ends_a, ends_b = list(accumulate(map(len, raw_a))), list(accumulate(map(len, raw_b)))
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append((ids_a[i:x], ids_b[j:y], [(ids_a[p], ids_b[q]) for p in range(i, x) for q in range(j, y) if ends_a[p] - len(raw_a[p]) < ends_b[q] and ends_b[q] - len(raw_b[q]) < ends_a[p]]))
        i, j = x, y
    shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in groups)
    return ids_a, ids_b, shown, [link for *_, own in groups for link in own]


def scores(rows, coders):
    found = [(key, *plain_alignment(text, coders)) for key, text in rows]
    count = Counter(p for *_, links in found for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        (-1 if key is None else key, len(a), len(b), shown.count("|"), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if shown else "")
        for key, a, b, shown, links in found
    )


def as_scores(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *[r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]) for r in df.collect())


HARD = [
    "a\n  b", "  x ", "", " ", "\n", "a  b", "tab\t\t x  \n y", "é è ▁x", "<s> </s> <|endoftext|> <unk> <0x41>", "\x00a b\x1c c", "　日本 語  テ", "a" * 3000 + " b", "x\n\n\n   ",
    "don't  it's  'll", "﻿hello ​ x", "ﬁ ① Ⅷ ｆｕ", "a\r\n b", "12345 67.8e9 ", "\U0001f600\U0001f600 \U0001f468‍\U0001f469", None, None, "a  b", "   \n  ", " x   y", "x \x85 y",
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [*enumerate(HARD), (3, "word word words"), (3, "word word words"), (None, "word of words")]
    return rows, spark.createDataFrame([(k, t, "en") for k, t in rows], SCHEMA).withColumn("n_a", F.lit("x")).withColumn("pairs", F.lit("y"))


@pytest.mark.parametrize("most", [1 << 18, 40, 0])
def test_alignment_of_hard_texts(hard, coders, most):
    rows, docs = hard
    assert as_scores(alignment.apply(docs, keep=["doc_id", "n_a", "lang"], most=most)) == scores(rows, coders)


def test_alignment_of_a_table(spark, coders):
    assert as_scores(registry.queries()["op12_alignment"](spark, SF)) == scores(documents(), coders)


def test_alignment_in_blocks_and_groups(hard, coders, monkeypatch):
    rows, docs = hard
    monkeypatch.setattr(alignment, "BLOCK", 3)
    p = alignment.pair(*alignment.default_paths())
    bits = (len(p.a_bytes) * len(p.b_bytes)).bit_length()
    texts = [t.encode() if t is not None else None for _, t in rows] + [b"\xff\xfe bad"]
    found = alignment.Aligned(len(texts), True)
    for units, of, counts in alignment._blocks(texts):
        found.add(p, units, of, counts, bits)
    at, pairs, times = found.pairs(bits)
    for i, (_, text) in enumerate(rows):
        a, b, shown, links = plain_alignment(text, coders)
        assert ("".join(found.groups[i])[:-1] if found.sound[i] else "") == shown
        assert dict(zip(pairs[at[i] : at[i + 1]].tolist(), times[at[i] : at[i + 1]].tolist())) == Counter(x * len(p.b_bytes) + y for x, y in links)
    assert at[-2] == at[-1]
    shown = {r["doc_id"]: r["groups"] for r in alignment.linked(docs.where("doc_id > 3"), keep=["doc_id"], with_groups=True).collect()}
    assert shown == {k: plain_alignment(t, coders)[2] for k, t in rows if k and k > 3}


def test_overlaps_by_hand():
    a, b = np.array([2, 3, 1, 4]), np.array([1, 1, 4, 2, 2])
    group_a, group_b, n, link_a, link_b = alignment.overlaps(a, b)
    assert group_a.tolist() == [0, 1, 1, 2] and group_b.tolist() == [0, 0, 1, 2, 2]
    assert list(zip(link_a.tolist(), link_b.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 2), (3, 3), (3, 4)]


def test_alignment_of_nothing(spark):
    assert alignment.apply(spark.createDataFrame([], SCHEMA), keep=["doc_id"]).collect() == []


# Lines


def key_of(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain_lines(rows, min_docs, keep_first, least=1):
    order = sorted({(key is not None, key or 0, text) if text is not None else (key is not None, key or 0, "") for key, text in rows})
    docs, seen = defaultdict(set), set()
    for d in order:
        for line in d[2].split("\n"):
            docs[key_of(line)].add(d)
    kept = {}
    for d in order:
        own = []
        for line in d[2].split("\n"):
            k = key_of(line)
            goes = len(k) >= least and len(docs[k]) >= min_docs and (not keep_first or k in seen)
            seen.add(k)
            if not goes:
                own.append(line)
        kept[d] = own
    out = []
    for key, text in rows:
        n, own = (text or "").count("\n") + 1, kept[(key is not None, key or 0, text or "")]
        out.append((-1 if key is None else key, n, n - len(own), "\n".join(own)))
    return sorted(out)


def as_lines(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect())


@pytest.fixture(scope="module")
def shared():
    """Lines that most, some or one document have, also within a document; null, empty and long texts; repeated rows."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        own = rng.choices(["Menu", " menu\t", "HOME | about", "", "  ", "\r", "Été", "été", "x"], k=rng.randint(0, 8)) + [f"line {rng.randint(0, 60)}" for _ in range(rng.randint(0, 5))]
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(400, None), (401, ""), (402, "\n"), (403, "Menu\n" * 20_000), rows[5], rows[5], (None, f"line 3\n{'y' * 100_000}\nMenu")]
    return rows


@pytest.mark.parametrize("min_docs, keep_first, least", [(10, False, 1), (1, True, 1), (3, True, 5), (2, False, 2)])
def test_lines_against_plain_python(spark, shared, min_docs, keep_first, least):
    docs = spark.createDataFrame([(k, t, "en") for k, t in shared], SCHEMA).withColumn("h1", F.lit("x")).withColumn("N_LINES", F.lit("y")).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lines.apply(docs, min_docs=min_docs, keep_first=keep_first, least_chars=least)
        assert got.columns == ["doc_id", "text", "lang", "h1", "n_lines", "n_dropped"]
        assert as_lines(got) == plain_lines(shared, min_docs, keep_first, least)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_range_holds_few_rows():
    """A run of a million equal lines goes through a range without being held, whatever the batches; its first row waits."""
    import pyarrow as pa

    stream = lines._Stream(10, False)
    most, given = 0, 0
    for start in range(0, 200_000, 1000):
        i = np.arange(start, start + 1000)
        cols = [np.zeros(1000, dtype=np.int64), np.zeros(1000, dtype=np.int64), i, i, i, np.zeros(1000, dtype=np.int32)]
        given += sum(b.num_rows for b in stream.add(pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=lines._ROW)))
        most = max(most, stream.rest.num_rows if stream.rest is not None else 0)
    last = list(stream.add(None))
    assert most < 10 and given + sum(b.num_rows for b in last) == 200_000 and last[-1].column(6).to_pylist() == [lines.HEAD]


def test_line_dedup_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(lines.SQL).fetchall()
    got = [tuple(r) for r in registry.queries()["op13_line_dedup"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
    plain = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in plain_lines(documents(), 10, False)]
    assert sorted(got) == plain and any(m for _, _, m, _ in plain)


def test_bitmaps_of_all_documents(spark, shared):
    docs = spark.createDataFrame([(k, t, "en") for k, t in shared], SCHEMA)
    maps = {(r["doc"], r["n_lines"]): r for r in lines.bitmaps(docs).collect()}
    assert len(maps) == len(set(shared))
    for (_, n), r in maps.items():
        assert lines.kept_lines(r["keep"], n).sum() == n - r["n_dropped"]
    assert len(maps[(403, 20_001)]["keep"]) < 100


def test_no_lines(spark):
    assert lines.apply(spark.createDataFrame([], SCHEMA)).collect() == []
