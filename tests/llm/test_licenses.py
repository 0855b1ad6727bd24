"""License scans against plain Python: places of phrases, votes, merged diagonals and edit distances of all documents and templates."""

from __future__ import annotations

import random

import pytest
from gridloom.llm import licenses, notices
from pyspark.sql import functions as F
from test_operators import EN, SCHEMA, SF, by_id, norm_words

TEMPLATES = [(label, text, True) for text, label in notices.PHRASES.items()] + [(label, text, False) for label, text in notices.NOTICES]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(text):
    """n_words, n_base, first, last, base labels, labels, score, spans."""
    w = norm_words(text)
    base, at, good = set(), [], set()
    for label, body, phrase in TEMPLATES:
        t = norm_words(body)
        if phrase:
            here = [i for i in range(len(w) - len(t) + 1) if w[i : i + len(t)] == t]
            at += here
            base |= {label} if here else set()
            continue
        k = 2 if len(t) < 10 else 4
        share = 0.4 if len(t) < 10 else 0.2
        where = {}
        for j in range(len(t) - k + 1):
            where.setdefault(tuple(t[j : j + k]), []).append(j)
        voted = {}
        for i in range(len(w) - k + 1):
            for j in where.get(tuple(w[i : i + k]), ()):
                voted.setdefault(i - j, []).append((i, j))
        groups = []
        for d in sorted(voted):
            if groups and d - groups[-1][-1] <= 3:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            if len({j for d in g for _, j in voted[d]}) < share * (len(t) - k + 1):
                continue
            start = min(g, key=lambda d: (min(i for i, _ in voted[d]), d))
            stop = max(g, key=lambda d: (max(i for i, _ in voted[d]), d))
            top = max(g, key=lambda d: (len({j for _, j in voted[d]}), -d))
            for a, b in {(start, stop), (top, top)}:
                a, b = max(a, 0), b + len(t)
                cut, whole = " ".join(w[a:b]), " ".join(t)
                longer = max(len(cut), len(whole))
                if min(len(cut), len(whole)) >= 0.8 * longer and 1 - distance(cut, whole) / longer >= 0.8:
                    good.add((a, b, label, 1 - distance(cut, whole) / longer))
    spans, last = [], None
    for a, b, label, similar in sorted(good):
        if last is None or a - last > 3:
            spans.append([])
        spans[-1].append((similar, label, a, b))
        last = a
    kept = sorted({max(s)[1:] for s in spans})
    labels = base | {s[0] for s in kept}
    score = 1.0 if base else max((max(s)[0] for s in spans), default=0.0)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, kept


def compare(got, text):
    want = brute(text)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"], got["labels"]) == want[:6], text
    assert got["score"] == pytest.approx(want[6]) and [tuple(s) for s in got["spans"]] == want[7]


def test_damaged_copies(spark):
    rng = random.Random(8)
    texts = []
    for label, body in notices.NOTICES:
        for damage in (0, 0.05, 0.1, 0.3):
            w = body.split()
            for i in range(len(w)):
                if rng.random() < damage:
                    w[i] = rng.choice([f"{w[i]} also", "other", "", w[i].upper(), w[i][1:]])
            texts.append(f"{EN} {' '.join(w)} {EN}")
    texts += [
        "Released under an MIT License", "released under this MIT license", EN + " Released under the very MIT License", "Licensed under CC BY-SA 4.0", "under the terms under the Licensed under the licensed under the Apache License, Version 2.0",
        "this work is licensed under the gnu general public license, version 3", "general public general public license " * 50, "All rights reserved. CC-BY CC BY " + EN, "Licensed under the Apache Licence, Version 2.0 " + EN, "all", "all rights",
        " ".join(["Released under the MIT License."] * 40), " ".join(rng.choice("cc by all rights reserved general public license the under mit".split()) for _ in range(400)), "Ünder the mıt lićense", "ALL RIGHTS RESERVED x all rights reserved", None, "", " \n ",
    ]
    docs = spark.createDataFrame([(i, t, "en", "z", 1) for i, t in enumerate(texts)], SCHEMA)
    got = by_id(licenses.scan(docs))
    for i, t in enumerate(texts):
        compare(got[i][0], t)
    at = {t: i for i, t in enumerate(texts)}
    for near in ("Released under an MIT License", "released under this MIT license", EN + " Released under the very MIT License"):
        assert got[at[near]][0]["labels"] == "mit" and 0.8 <= got[at[near]][0]["score"] < 1


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = by_id(licenses.op10_license_scan(spark, SF).withColumn("spans", F.array().cast("array<string>")))
    assert set(got) == set(texts)
    for i, t in texts.items():
        r, want = got[i][0], brute(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == want[:6] and r["score"] == pytest.approx(want[6])


def test_edges(spark):
    rows = [(1, "All rights reserved. " + EN, "en", "z", 1), (1, "All rights reserved. " + EN, "en", "z", 1), (2, None, "en", "z", 1), (None, "Released under the MIT License", None, None, None), (3, " ".join(f"w{i % 977}" for i in range(60_000)) + " Released under the MIT License", "en", "z", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for n in ("K1", "k2", "_text", "text2", "N_Words", "labels", "gram", "template"):
        docs = docs.withColumn(n, F.lit("x"))
    got = by_id(licenses.scan(docs))
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and got[1][0]["n_base"] == 1
    assert (got[2][0]["n_words"], got[2][0]["labels"], got[2][0]["score"]) == (0, "", 0.0) and got[None][0]["labels"] == "mit" and got[3][0]["labels"] == "mit" and got[3][0]["n_words"] == 60_005
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, notices=[], phrases={"reserved": "r"}).where("base_labels = 'r'").count() == 2
    assert licenses.scan(docs, notices=[], phrases={}).where("labels = ''").count() == 5


def test_text_is_carried_once_however_many_diagonals_vote(spark):
    text = "copies of the software and " * 4000
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x " * 700 + notices.MIT + " y" * 700)], "doc_id long, text string")
    known, kinds, chunk, most = licenses.templates(spark)
    voted = licenses.diagonals(licenses.votes(licenses.keyed(docs, "doc_id", "text"), known, kinds, chunk, most))
    own = voted.where("template IS NOT NULL AND excerpt IS NULL").count()
    size = voted.agg(F.sum(F.octet_length("excerpt.data"))).first()[0]
    assert own > 4000 and size < 6 * len(text), (own, size)
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()}
    assert "mit" in got[3].split(",") and got[2] == ""
