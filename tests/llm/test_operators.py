"""Every operator against brute force, and on the cases its docstring names."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekha.functions.expr import let
from lekha.llm import (html_text, line_dedup, mixing, near_dedup, neighbours, packing, quality, secret_scan, suffix_dedup,
                       toxicity)
from lekha.llm.queries import tokenizer_path

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # names that operators use inside
                     T.StructField("size", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("shard", T.StringType())])
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows = [(k, sentence(rng, rng.randint(1, 160)), f"s{k % 4}") for k in range(120)]
    for k in range(120, 160):  # near copies, some words changed
        words = rows[k - 120][1].split(" ")
        for _ in range(max(1, len(words) // 25)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words), "s0"))
    passage = sentence(rng, 60)
    rows += [(160 + k, sentence(rng, 20) + " " + passage + "\n" + sentence(rng, 20), None) for k in range(30)]
    rows += [(190 + k, rows[3][1], "s1") for k in range(20)]
    rows += [(210, None, "s1"), (211, "", None), (212, " \n\t", "s2"), (213, "one", "s2"), (214, "é" * 300, "s3"), (215, "ab " * 4000, "s3"),
             (3, rows[3][1], "s3"), (None, rows[5][1], "s0")]
    return rows


def test_mix(spark, corpus):
    docs = frame(spark, corpus)
    m = mixing.mix(docs, block=8, shard_slots=64)
    rows = mixing.taken_words(m).collect()
    assert len(rows) == len(corpus)
    sizes = collections.Counter()
    for _, t, s in corpus:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in order if s not in capped))
        over = {s for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    for r in rows:
        assert r["target"] == pytest.approx(2 * sizes[r["source"]] if r["source"] in capped else level * weight[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    for s in order:
        target = 2 * sizes[s] if s in capped else level * weight[s]
        assert abs(taken[s] - target) <= 16
    again = mixing.taken_words(mixing.mix(docs.repartition(7), block=8, shard_slots=64)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    slots = m.slots.collect()
    uses = collections.Counter((r["s"], r["epoch"], r["block"]) for r in slots)
    assert max(uses.values()) == 1
    mixed = mixing.mixed_documents(docs, m).collect()
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == sum(taken.values())


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97])
def test_permutation_is_a_bijection(spark, size):
    got = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size), F.lit(5)).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(size))


def _quality(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in collections.Counter(grams).items() if n > 1}
    hit = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, corpus):
    rows = corpus + [(300, "a b c a b c a b d # # |\nx\nx\n\n\nx", "s0")]
    got = quality.statistics(frame(spark, rows)).collect()
    own = collections.Counter((i, *_quality(t)) for i, t, _ in rows)
    assert own == collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_quality_rules_separate(spark):
    rng = random.Random(1)
    rows = [(k, sentence(rng, 90) if k % 4 else " ".join(w + "***" for w in sentence(rng, 90).split()), "s") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), None) for k in range(0, 400, 2)] + [(1, None, None), (3, 0, None), (3, 1, None)], LABELS)
    got = quality.judged(frame(spark, rows), labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 > 0) for r in got)
    kept = quality.kept_documents(frame(spark, rows), labels)
    assert kept.columns == DOCS.names and kept.count() == 300
    none = quality.judged(frame(spark, rows), labels.limit(0)).collect()
    assert all(r["kept"] for r in none)


def test_quality_statistics_are_computed_once(spark, monkeypatch):
    """The rows kept are those that the verdict of each row keeps, with ids and texts that repeat or are null."""
    rng = random.Random(2)
    starred = " ".join(w + "***" for w in sentence(rng, 90).split())
    plain = sentence(rng, 90)
    rows = [(k, sentence(rng, 90) if k % 4 else " ".join(w + "***" for w in sentence(rng, 90).split()), "s") for k in range(200)]
    rows += [(500, plain, "s"), (500, starred, "s"), (500, starred, "s"), (500, plain, "s"), (None, plain, "s"), (None, starred, "s"), (None, None, "s"), (501, None, "s"), (None, plain, "s")]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), None) for k in range(0, 200, 2)], LABELS)
    plain_statistics, calls = quality.statistics, []
    monkeypatch.setattr(quality, "statistics", lambda *a, **k: calls.append(1) or plain_statistics(*a, **k))
    kept = quality.kept_documents(frame(spark, rows), labels)
    assert len(calls) == 1
    want = collections.Counter((i, t) for i, t, _ in rows if t and "***" not in t)
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want


def test_secrets(spark):
    key = "q9Zx3LmT7vBn2KpR5sWd8YhF"
    text = f"é password: {'a1' * 6} x\nAKIA{'A' * 13} AKIA{'A' * 14} {'0f' * 8} {key} /usr/local/share/documents/of/people/today"
    rows = [(1, text, "s"), (2, None, "s"), (3, "", "s"), (4, "token=secret=abcdefghijkl", "s"), (5, "secret = short", "s"), (5, "secret = short", "s")]
    got = sorted(secret_scan.secrets(frame(spark, rows)).collect(), key=lambda r: r["doc_id"])
    at = text.index("password")
    spans = got[0]["spans"].split(",")
    assert spans[0] == f"assign:{at}:{at + 22}"
    start = text.index(key)
    assert f"entropy:{start}:{start + len(key)}" in spans and not any(text[int(s.split(":")[1])] == "/" for s in spans)
    assert (got[0]["n_assign"], got[0]["n_access"], got[0]["n_hex"]) == (1, 1, 1)
    base = ",".join(s for s in spans if not s.startswith("entropy"))
    assert got[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3]["n_assign"] == 1 and len(got) == 6


def test_entropy_windows():
    rng = random.Random(3)
    run = "".join(rng.choice("ABCDEFGHIJKLMNOPabcdefghij0123456789+") for _ in range(80)) + "a" * 40 + "1b2"
    want = set()
    for i in range(len(run) - 19):
        n = collections.Counter(run[i:i + 20])
        if -sum(c / 20 * np.log2(c / 20) for c in n.values()) >= 3.9 - 1e-9:
            want |= set(range(i, i + 20))
    assert {p for a, b in secret_scan.dense(run) for p in range(a, b)} == want


def test_pack(spark, corpus):
    from tokenizers import Tokenizer

    docs = frame(spark, [r for r in corpus if r[0] != 3 and r[0] is not None] + [(900, "It's <|endoftext|> don't 42x ÀÉ*** İx é.", "s"), (901, sentence(random.Random(2), 3000), "s")])
    own = Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    ids = {k: own.encode(t, add_special_tokens=False).ids + [1] for k, t in texts.items()}
    got = packing.pack(docs, tokenizer_path(), window=256).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, v in ids.items():
        at = 0
        for start, n in sorted(pieces[k]):
            assert start == at
            at += n
        assert at == len(v)
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 256 and at & (at - 1) == 0


def test_windows_are_filled_from_all_documents_by_all_words():
    """Every window against a plain pass: no word too common, no partner too far down the list."""
    rng = np.random.default_rng(11)
    common = 1 / np.arange(1, 61)
    texts = [rng.choice(60, rng.integers(1, 50), p=common / common.sum()) for _ in range(150)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = packing.packed(sizes, packing.Index(np.concatenate(texts), starts), 200)

    df, mean = collections.Counter(w for t in texts for w in set(t)), np.mean([len(t) for t in texts])

    def score(a, d):
        tf = collections.Counter(texts[d])
        return sum(np.log(1 + (150 - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(texts[d]) / mean))
                   for w in sorted(set(texts[a])))

    left, at, want = {d: int(n) for d, n in enumerate(sizes)}, collections.Counter(), []
    while left:
        seed = min(left)
        room, window = 200, []

        def take(d):
            nonlocal room
            n = min(room, left[d])
            window.append((d, at[d], n))
            room -= n
            at[d] += n
            left[d] -= n
            if not left[d]:
                del left[d]

        take(seed)
        ranked = sorted((d for d in left if score(seed, d) > 0), key=lambda d: -score(seed, d))
        for fits in (True, False):
            for d in ranked:
                if room and d in left and (not fits or left[d] <= room):
                    take(d)
        for d in sorted(left):
            if room:
                take(d)
        want.append((room, window))
    assert got[:len(want) - 1] == [w for room, w in want if not room]
    assert [p[:2] for p in got[len(want) - 1]][:1] == [p[:2] for p in want[-1][1]][:1]


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        words = sentence(rng, 60).split(" ")
        bad = k % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vile", "nasty", "rotten"])
        rows.append((k, " ".join(words), "s"))
        labels.append((k, None, int(bad)))
    got = toxicity.toxicity(frame(spark, rows + [(900, None, "s"), (None, "x", "s")]), spark.createDataFrame(labels + [(1, None, None)], LABELS)).collect()
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    good = sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    assert good / len(held) > 0.95
    none = toxicity.toxicity(frame(spark, rows[:3]), spark.createDataFrame([], LABELS)).collect()
    assert len(none) == 3


def _components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _shingles(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, corpus, width):
    got = near_dedup.near_duplicates(frame(spark, corpus), width).collect()
    assert len(got) == len(corpus)
    sets = [(i, _shingles(t, width)) for i, t, _ in corpus if i is not None]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    want = _components({i for i, _ in sets}, links)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] is not None) == sorted(len(s) for _, s in sets)


def test_near_pairs_under_one_template(spark):
    """Many pairs just over the similarity, whose documents share a template just under it."""
    rng = random.Random(31)
    template, rows = sentence(rng, 300), []
    for k in range(200):
        own = sentence(rng, 64).split(" ")
        near = [sentence(rng, 1) if i % 7 == 3 else w for i, w in enumerate(own)]
        rows += [(2 * k, f"{template} {' '.join(own)}", "s"), (2 * k + 1, f"{template} {' '.join(near)}", "s")]
    sets = [_shingles(t, 4) for _, t, _ in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) == 200
    want = _components(range(len(sets)), links)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), 4).collect()}
    assert got == want


def test_line_dedup(spark):
    rng = random.Random(9)
    long_ = sentence(rng, 120)
    near = long_.replace(long_.split(" ")[50], "other", 1)
    lines = {1: f"{long_}\nHello, World 12\n\n", 2: f"hello world  99\n{near}", 3: None, 4: "", 5: sentence(rng, 9) + "\n" + sentence(rng, 9), None: "Hello world 34"}
    docs = frame(spark, [(k, t, "s") for k, t in lines.items()] + [(5, lines[5], "s")])
    got = {r["doc_id"]: r for r in line_dedup.line_report(docs).collect()}
    assert got[1]["removed"] == "1" and got[None]["removed"] == "" and got[5]["n_removed"] == 0
    near_sims = [r["sim"] for r in line_dedup._lines(docs.where("doc_id in (1, 2)")).collect() if r["chars"] > 100]
    close = bin((near_sims[0] ^ near_sims[1]) & (2 ** 64 - 1)).count("1") <= line_dedup.DISTANCE
    assert got[2]["removed"] == ("0,1" if close else "0")
    assert got[3]["n_lines"] == 0 and got[4]["n_lines"] == 1
    out = line_dedup.deduped_documents(docs)
    assert out.columns == DOCS.names and out.count() == 7
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == f"{long_}\n\n" and texts[3] is None and texts[5] == lines[5]


@pytest.mark.parametrize("crowd", [512, 4])
def test_line_links_equal_brute_force(spark, monkeypatch, crowd):
    """Every pair of lines within the distance counts, whatever the ends of its buckets are."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd, raising=False)
    rng = random.Random(21)
    lines = []
    for _ in range(8):  # equal fingerprints: two orders of the same words, each with a near copy
        words = sentence(rng, 40).split(" ")
        for w in (words, words[::-1]):
            lines += [" ".join(w), " ".join([w[1], w[0], *w[2:]])]
    for _ in range(3):  # chains of small edits of one template
        words = sentence(rng, 150).split(" ")
        for _ in range(25):
            words = list(words)
            words[rng.randrange(150)] = sentence(rng, 1)
            lines.append(" ".join(words))
    rng.shuffle(lines)
    docs = frame(spark, [(k, t, "s") for k, t in enumerate(lines)])
    sims = {r["doc_id"]: r["sim"] for r in line_dedup._lines(docs).collect()}
    pairs = [(a, b, lines[a], lines[b]) for a in sims for b in sims
             if a < b and bin((sims[a] ^ sims[b]) & (2 ** 64 - 1)).count("1") <= line_dedup.DISTANCE]
    form = spark.createDataFrame(pairs, "a int, b int, s string, t string").select(
        "a", "b", *[F.regexp_replace(line_dedup.normal(F.col(c)), " +", " ").alias(c) for c in "st"])
    most = F.greatest(F.char_length("s"), F.char_length("t"))
    links = [(r["a"], r["b"]) for r in form.where(F.levenshtein("s", "t") <= F.floor(most * 0.2 + 1e-6)).collect()]
    want = _components(list(sims), links)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.line_report(docs).collect()}
    assert len(links) > 40 and got == {k: "" if want[k] == k else "0" for k in want}


def test_line_buckets_keep_what_can_meet(spark, monkeypatch):
    """Only fingerprints that meet a fitting length in their bucket go on, and no near pair of fitting lengths is lost, in crowded cells or others."""
    rng = random.Random(5)
    sims = []
    for _ in range(60):
        sims += [base := rng.getrandbits(64), base ^ (1 << rng.randrange(64)), base ^ sum(1 << b for b in rng.sample(range(64), 3))]
    rows = [(h, sim - (1 << 64) if sim >> 63 else sim, rng.randrange(40, 90)) for h, sim in enumerate(sims)]
    rows += [(1000, 1 << 40, 10), (1001, 3 << 40, 13), (1002, 1, 80), (1003, 2, 100), (1004, 4, 125), (1005, 8, 157)]
    classes = spark.createDataFrame(rows, "h long, sim long, chars int")
    want = {(min(s, t), max(s, t)) for _, s, a in rows for _, t, b in rows
            if s != t and bin((s ^ t) & (2 ** 64 - 1)).count("1") <= 3 and 100 * min(a, b) >= 80 * max(a, b)}
    slots = line_dedup._slots(classes)
    left = {r["sim"] for r in slots.collect()}
    assert not left & {1 << 40, 3 << 40, 8} and {s for pair in want for s in pair} <= left
    cells = line_dedup._cells(slots)[0].select("key", "band").distinct()
    assert {tuple(r) for r in line_dedup._met(slots, cells.limit(0)).collect()} == want
    apart = classes.groupBy("sim").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    assert {tuple(r) for r in line_dedup._crowds(slots, cells, apart).collect()} == want


def test_line_heads_reject_no_like_pair(spark):
    """The edit similarity is decided as by the plain distance, with lengths that differ and edits at one end."""
    rng = random.Random(8)
    pairs = []
    for n in range(300):
        s = sentence(rng, 60)
        cut = rng.randrange(len(s) // 3)
        t = rng.choice([s[cut:], s[:len(s) - cut], s[cut:] + s[:cut], sentence(rng, 60)[:cut] + s[cut:], s[:-cut or None] + sentence(rng, 60)[:cut], sentence(rng, 60)])
        pairs.append((n, n, *((s, t) if n % 2 else (t, s))))
    df = spark.createDataFrame(pairs, "a int, b int, s string, t string")
    most = F.floor(F.greatest(F.char_length("s"), F.char_length("t")) * 0.2 + 1e-6)
    want = {r["a"] for r in df.where(F.levenshtein("s", "t") <= most).collect()}
    assert 50 < len(want) < 250 and {r["a"] for r in line_dedup._alike(df).collect()} == want


def test_line_pieces_bound_and_settle(spark):
    """Cutting into pieces never says less than the edit distance and settles nearly all like pairs; odd lengths and letters included."""
    rng = random.Random(13)
    pairs = [(0, 0, "", "abc"), (1, 1, "abc", ""), (2, 2, "é" * 64, "é" * 64), (3, 3, "x" * 65, "x" * 63), (4, 4, "", "")]
    for n in range(5, 205):
        words = sentence(rng, rng.randrange(20, 400)).split(" ")
        other = list(words)
        for _ in range(len(words) // 12):
            at = rng.randrange(len(other))
            other[at:at + 1] = rng.choice([[], [sentence(rng, 1)], [other[at], "größe"]])
        pairs.append((n, n, " ".join(words), " ".join(other)))
    df = spark.createDataFrame(pairs, "a int, b int, s string, t string").withColumn(
        "most", F.floor(F.greatest(F.char_length("s"), F.char_length("t")) * 0.2 + 1e-6).cast("int"))
    got = df.select("a", "most", F.levenshtein("s", "t").alias("least"), line_dedup._piecewise("s", "t", "most").alias("cost")).collect()
    assert all(r["cost"] >= min(r["least"], r["most"] + 1) for r in got)
    like = [r for r in got if r["least"] <= r["most"]]
    assert len(like) > 195 and sum(r["cost"] <= r["most"] for r in like) > 0.95 * len(like)
    assert {r["a"] for r in line_dedup._alike(df.drop("most")).collect()} == {r["a"] for r in like}


def test_simhash_counts_bits(spark):
    rng = random.Random(4)
    rows = [(n, " ".join(sentence(rng, 1) for _ in range(n))) for n in (5, 6, 127, 128, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = F.transform(F.split(line_dedup.normal(F.col("text")), " +"), lambda w: F.xxhash64(w))
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", words.alias("h")).collect()}
    by_sums = {r["doc_id"]: r["sim"] for r in line_dedup._lines(docs).collect()}
    by_array = {r["doc_id"]: r["s"] for r in docs.select("doc_id", let(words, lambda h: line_dedup._fingerprint(h, 32)).alias("s")).collect()}
    for n, h in hashes.items():
        want = sum(1 << b for b in range(64) if sum((x >> b) & 1 for x in h) > len(h) // 2)
        assert by_sums[n] & (2 ** 64 - 1) == want and by_array[n] & (2 ** 64 - 1) == want


def test_suffix_blocks_equal_common_prefixes(monkeypatch):
    """Blocks are the groups of suffixes with one prefix of the length; a round settles two symbols."""
    rng = random.Random(31)
    sorts = []
    plain = np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or plain(*a, **k))
    for length in (1, 2, 7, 12):
        groups = [[bytes(rng.choice(b"ab\xfe") for _ in range(rng.choice([1, 2, 9, 30]))) for _ in range(8)] for _ in range(3)]
        made = [suffix_dedup.Transform(g) for g in groups]
        sorts.clear()
        order, block = suffix_dedup.merged_blocks(made, length)
        assert len(sorts) == len(made) + length // 2 + length % 2
        suffixes = [(k, r, g[r][at:]) for k, (g, t) in enumerate(zip(groups, made)) for r, at in zip(t.row, t.at)]
        # A suffix that ends before the length is a block of its own.
        want = [s[:length] if len(s) >= length else (s, k, r) for k, r, s in suffixes]
        assert sorted(order) == list(range(len(want)))
        assert [want[i][:length] if isinstance(want[i], bytes) else want[i][0] for i in order] == sorted(s[:length] for _, _, s in suffixes)
        of = {}
        assert all(of.setdefault(b, want[i]) == want[i] for i, b in zip(order, block)) and len(of) == len(set(want))


def test_suffix_pieces_of_few_bytes_need_no_codec(monkeypatch):
    for data in (b"", b"ab", bytes(range(256)) * 3, b"x" * 5000):
        assert suffix_dedup._full(suffix_dedup._squeezed(data)) == data
    monkeypatch.setattr(suffix_dedup.pa, "Codec", None)
    assert suffix_dedup._full(suffix_dedup._squeezed(b"ab" * 100)) == b"ab" * 100


def test_suffix_dedup(spark, corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    rows = [r for r in corpus if r[0] is not None]
    got = suffix_dedup.repeated_spans(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    first = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(i, first.get(b[k:k + 50], i))
    texts = {i: (t or "").encode() for i, t, _ in rows}
    for r in got:
        b = texts[r["doc_id"]]
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < r["doc_id"]:
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:350] = x[99]  # a hot vector
    rows = [(int(k), [float(v) for v in x[k]]) for k in range(700)]
    rows += [(700, None), (800, [0.0] * 8), (900, [float("nan")] * 8), (1000, [1.0, None] + [0.0] * 6), (701, [1.0, 2.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    hits = total = 0
    for q in range(0, 700, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(700), d))[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in own)
        hits += len(set(want) & {v for _, v, _ in own})
        total += 10
    assert hits / total >= 0.9 and {r["query_id"] for r in got} == set(range(0, 700, 100))


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><nav><a href=x>Home</a></nav>
    <div class="ad">Buy things now.</div><article><h1>A  headline</h1><p>First &amp; longer paragraph of the page, with words.<p>Second one
    goes here &#233;.</p></article><aside>Other stories</aside><div class="comments"><p>I liked this article very much, it was good.</p></div>
    <form><p>Your mail</p></form><footer>&copy; 2020</footer>"""
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", page, "clash"), (2, "u", None, None), (3, None, "", None), (4, "u", "<p", None), (5, "u", "<script>never closed <p>x", None), (1, "u", page, "clash")]
    got = sorted(html_text.main_text(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r["page_id"])
    want = "A headline\nFirst & longer paragraph of the page, with words.\nSecond one goes here é."
    assert got[0]["text"] == want and got[0]["n_chars"] == len(want) and got[1]["text"] == want
    assert got[2]["text"] == "" and got[3]["text"] == "" and got[5]["text"] == "" and len(got) == 6


def test_main_text_keeps_articles_whose_names_mislead():
    kept = "Plato held that forms are more real than the things we see."
    assert html_text.content(f'<article><div class="story-social-body"><p>{kept}</p></div></article>') == kept
    assert html_text.content(f'<section id="form"><p>{kept}</p></section>') == kept
    assert html_text.content(f'<div class="entry-header"><h1>A title</h1></div><p>{kept}</p>') == f"A title\n{kept}"
    assert html_text.content(f'<div class="site-header"><p>Our site, since 1999.</p></div><p>{kept}</p>') == kept
    assert html_text.content(f"<p>{kept}</p><table><tr><td>1</td><td>Year</td></tr></table>") == f"{kept}\n1\nYear"
    assert html_text.content(f"<p>{kept}</p><script>if (a < b) document.write('<article><p>no</p>')</SCRIPT ><p>{kept}</p>") == f"{kept}\n{kept}"


@pytest.mark.parametrize("page", ["<p>text of it.</p>" + "<script>x</script>" * 8000, "<script>" * 8000, "<div>" * 4000 + "<p>deep words of it.</p>" * 4000,
                                  "<div>" * 4000 + "</b>" * 8000, "<textarea>" * 8000 + "<p>"])
def test_main_text_takes_linear_time(page):
    start = time.perf_counter()
    html_text.content(page)
    assert time.perf_counter() - start < 2


def test_min_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(30):
        n = rng.randint(1, 7)
        score = [rng.uniform(-2, 2) for _ in range(n)]
        ties = [rng.uniform(0, 1) for _ in range(n - 1)]
        flow = html_text.Flow(n + 2)
        for i, s in enumerate(score):
            flow.edge(n, i, max(s, 0), 0)
            flow.edge(i, n + 1, max(-s, 0), 0)
            if i:
                flow.edge(i - 1, i, ties[i - 1], ties[i - 1])
        side = flow.run(n, n + 1)[:n]

        def cost(keep):
            return (sum(max(s, 0) for s, k in zip(score, keep) if not k) + sum(max(-s, 0) for s, k in zip(score, keep) if k)
                    + sum(t for t, a, b in zip(ties, keep, keep[1:]) if a != b))

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(side) == pytest.approx(best)


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], LABELS)
    assert mixing.taken_words(mixing.mix(docs)).count() == 0
    assert quality.judged(docs, labels).count() == 0
    assert secret_scan.secrets(docs).count() == 0
    assert packing.pack(docs, tokenizer_path()).count() == 0
    assert toxicity.toxicity(docs, labels).count() == 0
    assert near_dedup.near_duplicates(docs).count() == 0
    assert line_dedup.line_report(docs).count() == 0
    assert suffix_dedup.repeated_spans(docs).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == columns and 0 < kept.count() <= before, name
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_near_dedup_stage_keeps_rows_without_id(spark, corpus):
    import corpus_pipeline

    rows = [r for r in corpus if r[0] is not None][:160] + [(None, corpus[5][1], "s0"), (None, "a text of its own", "s1"), (None, None, "s2")]
    docs = frame(spark, rows)
    kept = {r["doc_id"] for r in near_dedup.near_duplicates(docs, 5).collect() if r["kept"]}
    got = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert got.columns == DOCS.names
    own = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert own == collections.Counter((i, t) for i, t, _ in rows if i in kept) and sum(n for (i, _), n in own.items() if i is None) == 3


def test_token_ids_of_words_cut_once_per_core_and_tail(monkeypatch):
    """Ids equal the tokenizer's for whole texts; words that differ by case or marks share their cuts."""
    words = packing.Words(tokenizer_path())
    cut = []
    real = packing.Words._piece
    monkeypatch.setattr(packing.Words, "_piece", lambda self, piece: cut.append(piece) or real(self, piece))
    texts = ["House", "house,", "HOUSE,", "don't", "x'", "''", "...", "Ärger!?", "ßÞ", "a1b2", "ಕನ್ನಡ.", "🙂,", "end'.", "É", "_"]
    flat, sizes = words.ids(pa.array(["skipped", *texts]).slice(1))
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    assert cut.count("house") == 1 and cut.count(",") == 1
    flat, sizes = words.ids(pa.array([], pa.string()))
    assert len(flat) == len(sizes) == 0
