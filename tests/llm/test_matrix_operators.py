"""Whitening, divergence audit and license scan against brute force, and on the cases their docstrings name."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compare import connect, difference
from lekha.llm import divergence, license_scan, queries, whitening

# names that the operators use inside
CLASH = ["id", "kept", "x", "index", "n", "key", "w", "term", "row", "template", "count"]


# ---- whitening ----------------------------------------------------------------------------------


def vectors(spark, rows):
    fields = [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
              *[T.StructField(c, T.StringType()) for c in CLASH]]
    return spark.createDataFrame([(i, v, *["z"] * len(CLASH)) for i, v in rows], T.StructType(fields))


def expected(good, components):
    x = np.floor(64 * np.array(good)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = n * x.astype(object) - s
    y = (z / n).astype(float)
    e, q = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:components]
    return (z ** 2).sum(axis=1), y @ q[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize("slab_rows, block_bytes", [(1 << 26, 4 << 20), (40, 900), (1, 1)])
def test_whitening_equals_numpy(spark, slab_rows, block_bytes):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6))).tolist() + [[0.0] * 6]
    good += [good[0]] * 20  # repeated rows
    bad = [None, [], [1.0] * 5, [None] + [1.0] * 5, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1e300] * 6]
    rows = [(None if k == 7 else k % 160, v) for k, v in enumerate(good)] + [(1000 + k, v) for k, v in enumerate(bad)]
    table = vectors(spark, rows).repartition(5)
    w = whitening.whiten(table, keep=["vec_id", *CLASH], components=4, slab_rows=slab_rows, block_bytes=block_bytes)
    deviation, projected, explained = expected(good, 4)
    got = w.rows.collect()
    assert len(got) == len(good) == w.n and w.identity_error < 1e-9
    np.testing.assert_allclose(w.explained, explained, rtol=1e-9)
    by_deviation = collections.defaultdict(list)
    for d, p in zip(deviation, projected):
        by_deviation[int(d)].append(p)
    signs = None
    for r in got:
        p = np.array(r["whitened"])
        near = min(by_deviation[int(r["deviation"])], key=lambda q: np.abs(np.abs(q) - np.abs(p)).max())
        np.testing.assert_allclose(np.abs(p), np.abs(near), atol=1e-8)
        if signs is None and np.abs(near).min() > 1e-3:
            signs = np.sign(near) * np.sign(p)  # either sign, the same for all rows
        if signs is not None:
            np.testing.assert_allclose(p * signs, near, atol=1e-8)
        assert all(r[c] == "z" for c in CLASH)


def test_whitening_of_huge_entries_is_exact(spark):
    rows = [(0, [2.0 ** 50, 1.0]), (1, [-(2.0 ** 50), 2.5]), (2, [3.0, -7.0])]
    w = whitening.whiten(vectors(spark, rows))
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(v) for v in zip(*x)]
    assert {r["vec_id"]: int(r["deviation"]) for r in w.rows.collect()} == {
        i: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}


def test_whitening_without_variance_or_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [5.0])]):
        assert whitening.whiten(vectors(spark, rows)).rows.count() == 0
    flat = whitening.whiten(vectors(spark, [(k, [float(k), 4.0]) for k in range(9)]))
    assert len(flat.explained) == 1 and flat.explained[0] == pytest.approx(1)


def test_whitening_query(spark):
    rows = queries.op11_whitening(spark, "/root/testdata/sf0.001")
    assert dict(rows.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                 "explained": "double", "identity_error": "double"}
    got = rows.collect()
    n = got[0]["n"]
    assert len(got) == n * 32 and {r["component"] for r in got} == set(range(1, 33)) and got[0]["identity_error"] < 1e-4


# ---- divergence ----------------------------------------------------------------------------------


def documents(spark, rows):
    fields = [T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source", *CLASH)]]
    return spark.createDataFrame([(k, *r, *["z"] * len(CLASH)) for k, r in enumerate(rows)], T.StructType(fields))


def audit_by_hand(rows, least=3, top=200):
    terms = [([w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))], l or "", s or "")
             for t, l, s in rows]
    docs = collections.Counter((l, w) for ws, l, _ in terms for w in set(ws))
    vocabulary = collections.defaultdict(list)
    for (l, w), n in docs.items():
        if n >= least:
            vocabulary[l].append(w)
    count = collections.defaultdict(collections.Counter)
    groups = {(l, s) for _, l, s in terms}
    for ws, l, s in terms:
        for w in ws:
            if docs[l, w] >= least:
                count[l, s][w] += 1
                count[l, None][w] += 1

    def share(l, s):
        c, v = count[l, s], len(vocabulary[l])
        return {w: 1 + 10**9 * (c[w] + 1) // (c.total() + v) for w in vocabulary[l]}

    out = set()
    for l, s in groups:
        p, q = share(l, s), share(l, None)
        others = {}
        for l2, s2 in groups:
            if l2 == l and s2 != s:
                r = share(l, s2)
                others[s2] = sum((p[w] - r[w]) ** 2 // r[w] for w in p)
        words = {w: (p[w] - q[w]) ** 2 // q[w] for w in p if count[l, s][w] and p[w] > q[w]}
        for part, values, most in (("pair", others, 10**9), ("term", words, top)):
            ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
            out |= {(l, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked[:most])}
    return out


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(4)
    words = ["the", "of", "Élan", "naïve", "ZEBRA", "ab", "x", "日本", "don't", "a1b"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = []
    for k in range(240):
        n = rng.choice([0, 1, 5, 30, 80])
        rows.append((" ".join(rng.choice(words[:rng.choice([5, 50, 210])]) for _ in range(n)), rng.choice(["en", "de"]), f"s{int(rng.random() ** 2 * 9)}"))
    rows += [(None, "en", "s0"), ("", None, None), ("lone words", "xx", "only"), ("other", "xx", "second"), (None, "xx", None)]
    rows += [("the same the same", "en", "s1")] * 5
    return rows


@pytest.mark.parametrize("sources, entries", [(48, 1 << 18), (2, 50)])
def test_divergence_equals_plain_counts(spark, audited, monkeypatch, sources, entries):
    """One block, and many blocks of sources and terms."""
    monkeypatch.setattr(divergence, "_SOURCES", sources)
    monkeypatch.setattr(divergence, "_ENTRIES", entries)
    got = [tuple(r) for r in divergence.audit(documents(spark, audited), top=20).collect()]
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(audited, top=20)


def test_joint_tables_are_products_of_indicators(spark):
    kept = spark.createDataFrame([("l", s, t, n) for t, row in enumerate([(1, 2, 0), (1, 2, 3), (0, 1, 1), (5, 0, 0)])
                                  for s, n in zip("pqr", row) if n], "lang string, source string, term long, n long").withColumn("term", F.col("term").cast("string"))
    sizes = spark.createDataFrame([("l", 3, 8)], "lang string, sources long, entries long")
    got = {tuple(r)[1:] for r in divergence.joint_tables(kept, sizes).collect()}
    assert got == {("p", 1, "q", 2, 2), ("p", 1, "r", 3, 1), ("q", 2, "r", 3, 1), ("q", 1, "r", 1, 1)}


def test_divergence_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(queries.op12_divergence(spark, sf), connect(sf), queries.ORACLES["op12_divergence"]) is None
    assert divergence.audit(documents(spark, [])).count() == 0


# ---- licenses --------------------------------------------------------------------------------------


def scanned(spark, texts):
    rows = license_scan.scan(documents(spark, [(t, "en", "s") for t in texts]), keep=["doc_id", *CLASH]).collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: r for r in rows}


def test_license_base_equals_brute_force(spark):
    rng = random.Random(9)
    pieces = ["under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by", "nc", "the mit", "license", "version 2", "word", "ñandú", "x_y"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 4, 25]))) for _ in range(150)] + [None, "", "cc", "cc by", "cc by nc " * 3]
    texts += [texts[3]] * 4
    got = scanned(spark, texts)
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(i, label) for label, phrase in license_scan.PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        r = got[k]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_notices_survive_edits(spark):
    mit, by, by_sa = (next(t for label, t in license_scan.NOTICES if label == name) for name in ("mit", "cc-by", "cc-by-sa"))
    words = mit.split(" ")
    lost = " ".join(words[:20] + words[22:50] + ["indeed"] + words[50:])
    texts = ["before " + mit + " after", lost, " ".join(words[:20]), by, by_sa, by + " " + by, "All rights reserved. Permission is hereby granted to nobody.",
             "word " * 100_000 + mit]
    got = scanned(spark, texts)
    assert [got[k]["labels"] for k in range(8)] == ["mit", "mit", "", "cc-by", "cc-by-sa", "cc-by", "", "mit"]
    assert got[0]["score"] == 1 and 0.8 <= got[1]["score"] < 1 and got[2]["score"] == 0 and got[7]["n_words"] > 100_000
    spans = license_scan.spans(license_scan.diagonals(documents(spark, [(by + " " + by, "", "")]), license_scan.templates(spark))).where("kind = 'notice'")
    n = len(re.findall(r"\w+", by.lower()))
    assert sorted((r["first"], r["last"]) for r in spans.collect()) == [(0, n), (n, 2 * n)]


def test_license_empty_table(spark):
    assert license_scan.scan(documents(spark, [])).count() == 0
