"""The pipeline against plain Python over whole tables at the smallest scale."""

from __future__ import annotations

import corpus_pipeline
from gridloom.llm import bpe, common, decontaminate, language, quality, simhash
from pyspark.sql import functions as F
from test_operators import DE, EN, SCHEMA, brute_fingerprint, brute_hits, brute_measures, words

SF = "/root/testdata/sf0.001"


def five_words(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]


def test_run_equals_plain_python(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # Quality: no host of these tables fails mostly, so each document's own rules decide.
    kept = {}
    for i, r in docs.items():
        n, _, symbols, lines, dups, repeats = brute_measures(r["text"])
        if not (n < 20 or 100 * repeats > 30 * n or symbols > n or 100 * dups > 50 * lines):
            kept[i] = r
    assert {r["doc_id"] for r in quality.keep(spark.read.parquet(f"{SF}/documents.parquet")).collect()} == set(kept)
    # Language: the same model, asked document by document.
    frame = spark.createDataFrame(list(kept.values()), spark.read.parquet(f"{SF}/documents.parquet").schema)
    model = language.train(frame.where(language.remainder() != 2))
    kept = {i: r for i, r in kept.items() if (p := model.predict([r["text"].encode()]))[0][0] != "und" and p[1][0] >= 0.1}
    # Near copies: all pairs of fingerprints, and of sets of five words.
    ids = sorted(kept)
    fps = {i: brute_fingerprint(kept[i]["text"]) for i in ids}
    sets = {i: five_words(kept[i]["text"]) for i in ids}
    gone: set[int] = set()
    label = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and ((fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    gone = {i for i in ids if label[i] != i}
    kept = {i: r for i, r in kept.items() if i not in gone}
    # Benchmark passages: cut where plain search finds them.
    texts = {}
    for i, r in kept.items():
        text = r["text"]
        n, hit, _ = brute_hits(text, items)
        if hit * 2 <= n:
            texts[i] = text if not hit else None
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts)
    e = bpe.encoder(bpe.default_path())
    for i, r in got.items():
        assert r["decodes"] and r["n_tokens"] == len(r["ids"])
        text = e.decode(r["ids"]).decode()
        if texts[i] is not None:
            assert text == texts[i]
        else:
            assert brute_hits(text, items)[1] == 0 and len(text) < len(kept[i]["text"])
    assert decontaminate.WINDOW == 10


def through(spark, docs):
    """Each stage over what the one before it returns."""
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    return out


def test_odd_rows_and_clashing_columns_through_all_stages(spark):
    long_text = " ".join(f"w{i * i % 9973}x{i % 13}" for i in range(120_000))
    rows = [(1, EN, "en", "a", 1), (1, EN, "en", "a", 1), (2, EN, "en", "b", 1), (3, None, "en", "a", None), (4, "", None, None, 0), (5, DE, "de", None, 5), (6, long_text, "en", "b", 9), (None, DE + " noch", "de", "a", 1), (7, DE + " mehr", None, "c", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for n in ("_row", "_text", "_k1", "fp", "score", "kept", "spans", "_cut", "n_words", "host"):
        docs = docs.withColumn(n, F.lit(n))
    out = through(spark, docs)
    for df in out[1:-1]:
        assert df.columns == docs.columns and df.where("_row <> '_row' OR kept <> 'kept' OR fp <> 'fp'").isEmpty()
    assert {r["doc_id"] for r in out[1].collect()} == {1, 2, 5, 6, None, 7} and out[1].count() == 7
    kept = [r["doc_id"] for r in out[3].collect()]
    # Copies of 1 go, also its own; of the German ones the smallest number stays.
    assert sorted(kept) == [1, 5, 6]
    last = {r["doc_id"]: r for r in out[5].collect()}
    assert out[5].columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decodes"] and set(last) == {1, 5, 6} and all(r["decodes"] for r in last.values())
    assert bpe.encoder(bpe.default_path()).decode(last[6]["ids"]).decode() == long_text


def test_no_documents(spark):
    assert [df.count() for df in through(spark, spark.createDataFrame([], SCHEMA))] == [0] * 6


def test_near_dedup_broadcasts_only_what_is_small_as_rows(spark):
    """The flips of a half are 33 times what Spark expects, so that side is never broadcast, whatever the limit."""
    fps = spark.createDataFrame([(1 << i,) for i in range(40)], "fp long")
    hits = simhash.crowded(fps)
    assert "BroadcastHashJoin" not in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 40
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        for value, inside in ("64m", 1 << 20), ("10k", 10 << 10), ("-1", -1):
            spark.conf.set(key, value)
            try:
                with common.bounded_broadcasts(spark):
                    assert int(spark.conf.get(key)) == inside
                    raise KeyError
            except KeyError:
                assert spark.conf.get(key) == value
    finally:
        spark.conf.set(key, before)


def test_near_dedup_in_one_slice_and_in_several(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for most in simhash.SLICE, 1:
        monkeypatch.setattr(simhash, "SLICE", most)
        kept.append(sorted(r["doc_id"] for r in simhash.keep(docs).collect()))
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()
