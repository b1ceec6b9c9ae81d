"""Ranks, splits, dedupe, labels, consensus and packing."""

import collections
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekha.operators import consensus, dedupe, frames as fr, joins, labels, packing, ranking, reports, splits


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


# ---- ranks and percentiles ----------------------------------------------------


def test_rank_and_running_sum_equal_a_plain_window(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g"),
                                  (F.col("id") * 37 % 101).alias("v"))
    w = W.partitionBy("g").orderBy("id")
    want = df.select("id", F.row_number().over(w).alias("r"),
                     F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    chunk = F.floor(F.col("id") / 64)
    got = ranking.with_running_sum(ranking.with_rank(df, ["g"], ["id"], chunk, "r"), ["g"], ["id"], chunk, F.col("v"), "s")
    assert sorted(got.select("id", "r", "s").collect()) == sorted(want.collect())
    few = ranking.with_rank(df, ["g"], ["id"], chunk, "r", at_most=5)
    assert few.count() == 10


@pytest.mark.parametrize("n", [1, 2, 9, 30000])
def test_exact_percentiles(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 10007).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    at = [0.0, 0.1, 0.5, 0.9, 1.0]
    want = df.agg(F.percentile("v", at)).first()[0]
    assert ranking.exact_percentiles(df, "v", at).first()["p"] == pytest.approx(want)
    per = {r["g"]: r["p"] for r in ranking.exact_percentiles(df, "v", at, ["g"]).collect()}
    for r in df.groupBy("g").agg(F.percentile("v", at).alias("p")).collect():
        assert per[r["g"]] == pytest.approx(r["p"])


# ---- splits -------------------------------------------------------------------------


def test_hash_split_is_the_published_rule_and_ignores_partitions(spark):
    import hashlib

    df = splits.hash_split(spark.range(500), "id", "s2", 38)
    got = {r["id"] for r in df.repartition(9).where("is_test").collect()}
    assert got == {i for i in range(500) if hashlib.sha256(f"s2:{i}".encode()).digest()[0] < 38}


def test_samples_have_exact_sizes_and_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    a, b = (ids(splits.sample_n(x, ["id"], 50)) for x in (df, df.repartition(13)))
    assert a == b and len(a) == 50
    strata = splits.stratified(df, "g", "id", 20)
    assert strata.count() == 20 and strata.groupBy("g").count().agg(F.max("count")).first()[0] == 3
    assert splits.stratified(df, "g", "id", 5000).count() == 1000
    with pytest.raises(Exception, match="fewer than"):
        splits.sample_pages(df, "g", 8).collect()
    assert splits.whole_pages(df.withColumn("p", F.lit("a")), "p", "id", 10).count() == 10


def test_fill_budget_holdout_and_curves(spark):
    df = spark.range(100).withColumn("is_test", F.col("id") < 10).withColumn("one", F.lit(1)).withColumn("g", F.lit("x"))
    filled = splits.fill_to(df, "is_test", "id", 25)
    assert filled.count() == 25 and filled.where("is_test").count() == 10
    assert splits.pages_to_budget(df.withColumn("n", F.lit(4)), "g", "id", "n", 10).count() == 3  # 12 overshoots 10
    held = splits.holdout_every(df, "g", ["id"], 4, F.floor(F.col("id") / 8))
    assert ids(held.where("demo_split = 'holdout'")) == list(range(3, 100, 4))
    assert splits.holdout_every(df, "g", ["id"], 1, F.lit(0)).where("demo_split = 'holdout'").count() == 0
    curve = splits.learning_curve(df, "id", [5, 20])
    small, large = (set(ids(curve.where(F.col("subset") == s))) for s in (5, 20))
    assert len(small) == 5 and len(large) == 20 and small < large
    assert splits.hash_permutation_split(df.drop("is_test"), "id", 0.2).where("is_test").count() == 20


def test_frozen_ids_never_move(spark):
    frozen = spark.createDataFrame([(0, True), (1, False)], "id long, is_test boolean")
    out = {r["id"]: r["is_test"] for r in splits.frozen_split(spark.range(50), frozen, "id", "s2", 256).collect()}
    assert out[0] is True and out[1] is False and all(out[i] for i in range(2, 50))


# ---- joins and dedupe --------------------------------------------------------------------


def test_guards_fail_loudly(spark):
    a = spark.range(5).withColumnRenamed("id", "row_id")
    with pytest.raises(Exception, match="row counts differ"):
        joins.positional_join(a, a.limit(3)).collect()
    with pytest.raises(Exception, match="missing"):
        joins.require_all(spark.range(5), spark.range(4), "id").collect()
    with pytest.raises(Exception, match="overlap"):
        joins.require_disjoint("id", x=spark.range(3), y=spark.range(2, 5)).collect()
    assert joins.require_disjoint("id", x=spark.range(3), y=spark.range(3, 5)).count() == 2


@pytest.mark.parametrize("name", ["a12_run_registry", "c10_disjoint_sets"])
def test_every_language_takes_part(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as entry
    from compare import difference

    langs = ["en", "de", "it", "a/b=c", "01", "", None, "en", None, "__HIVE_DEFAULT_PARTITION__"]
    rows = [(k, x, k + 5) for k, x in enumerate(langs)] + [(None, "en", None), (None, None, 3), (None, "xx", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) is None


def test_disjoint_values_fail_loudly(spark):
    for rows in ([(1, "x"), (1, None)], [(1, None), (1, None)], [(1, "x"), (1, "y")]):
        with pytest.raises(Exception, match="overlap"):
            joins.require_disjoint_values(spark.createDataFrame(rows, "id long, s string"), "s", "id").collect()


def test_null_signature_never_excludes(spark):
    schema = "stem string, width int"
    pages = spark.createDataFrame([("a", None), ("b", 1), ("c", 2)], schema)
    gone = spark.createDataFrame([("x", None), ("y", 1)], schema)
    kept = joins.exclude_pages(pages, spark.createDataFrame([("c", 0)], schema), gone, ["width"])
    assert ids(kept, "stem") == ["a"]


def test_photo_dedupe(spark):
    rows = [("d/hd_images/1.1.jpg", 0, 10), ("d/std/1.1(1).jpg", 1, 20), ("d/std/1.1.jpg", 2, 20), ("d/hd_images/1.2.jpg", 3, None)]
    df = spark.createDataFrame(rows, "path string, file_pos int, width int")
    for c in ("height", "sharpness", "contrast", "brightness"):
        df = df.withColumn(c, F.lit(1))
    assert ids(dedupe.first_per_signature(df), "file_pos") == [0, 1]
    assert ids(dedupe.one_per_page(df), "file_pos") == [1, 3]


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("key"), "id")
    plan = dedupe.first_per_key(df, ["key"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


# ---- labels ----------------------------------------------------------------------------------


def test_funnel_counts_first_failures_and_adds_up(spark):
    texts = ["ಮನೆ ಮನೆ ಮನೆ"] * 9 + ["", "ಮನೆ", "ಮನೆ ಮನೆ x", "ಮನೆ " * 60, "ಗಿಡ ಗಿಡ ಗಿಡ"]
    label = [(f"c{i:02}", "main", t) for i, t in enumerate(texts)] + [("zz", "main", "ಮನೆ ಮನೆ ಮನೆ")]
    label += [("c13", "other", "ಕಾಡು ಕಾಡು ಮೇಡು"), ("c00", "other", "ಮನೆ ಮನೆ ಮನ"), ("c01", "other", " ")]
    crop = [(f"c{i:02}", f"{1 + (i == 8)}.1", 640 + i % 3, 64) for i in range(len(texts))]
    rows = spark.createDataFrame(label, "crop string, labeller string, text string")
    crops = spark.createDataFrame(crop, "crop string, page string, width int, height int")
    out = labels.build_label_set(rows, crops, group="1")
    got = {r["reason"]: r["n"] for r in labels.funnel(out).collect()}
    assert got == {"kept": 8, "group": 1, "empty": 1, "short": 1, "unencodable": 1, "length": 1, "disagreement": 1, "unmatched": 1}
    assert sum(got.values()) == len(texts) + 1
    report = labels.cross_check_report(out).first()
    assert report["n_cross_checked"] == 2 and report["n_kept"] == 8
    few = labels.build_label_set(rows, crops.where("crop < 'c03' or crop = 'c12'"))
    assert {r["reason"]: r["n"] for r in labels.funnel(few).collect()}["kept"] == 4  # no band below eight rows


def test_pending(spark):
    crops = spark.createDataFrame([("a",), ("b",), ("c",)], "crop string")
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "crop string, text string")
    assert ids(labels.pending_crops(crops, rows), "crop") == ["b", "c"]


# ---- consensus ---------------------------------------------------------------------------------


def readings(spark, *texts):
    return spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "crop string, sample_idx int, text string")


def agree(spark, *texts, below=1.0):
    df = readings(spark, *texts)
    bases = consensus.medoids(df)
    slots = consensus.consensus_slots(consensus.position_votes(df, bases))
    unsure = consensus.uncertain_slots(slots, below)
    found = {r["pos"]: {a["char"]: round(a["prob"], 3) for a in r["alternatives"]} for r in unsure.collect()}
    return bases.first()["base"], found, bases, unsure


def random_readings(seed, n=7):
    rng = random.Random(seed)
    return ["".join(rng.choice("rst") for _ in range(6)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_votes_equal_an_independent_count(spark, seed):
    """Readings of one length that differ in letters only: a vote is what stands there."""
    rng = random.Random(seed)
    base = "abcdefgh"
    texts = [base] * 5 + [base[:i] + rng.choice("xyz") + base[i + 1:] for i in (0, 3, 3, 7)]
    found = agree(spark, *texts)
    assert found[0] == base
    for pos, alternatives in found[1].items():
        assert alternatives == {c: round(sum(t[pos] == c for t in texts) / len(texts), 3) for c in {t[pos] for t in texts}}
    assert set(found[1]) == {i for i in range(len(base)) if len({t[i] for t in texts}) > 1}


def test_copies_equal_weights_and_order_decides_ties_only(spark):
    texts = random_readings(3, 4)
    assert agree(spark, *texts, *texts)[1] == agree(spark, *texts)[1]
    clear = texts + [texts[0]] * 9
    assert agree(spark, *clear)[:2] == agree(spark, *reversed(clear))[:2]


def test_blank_readings_have_no_vote(spark):
    assert agree(spark, " ", "", "\t")[:2] == ("", {})
    assert agree(spark, "rst", " ", "rst")[:2] == ("rst", {})


def test_variant_lines_replace_one_letter(spark):
    _, contested, bases, unsure = agree(spark, "stone", "stone", "stane", "store")
    lines = consensus.variant_lines(bases, unsure).collect()
    assert sum(r["rank"] == 0 for r in lines) == 1
    assert {r["text"] for r in lines if r["rank"] > 0} == {"stane", "store"} and set(contested) == {2, 3}


def test_weighted_distances_equal_all_pairs(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab ") for _ in range(5)) for _ in range(4)] * 3 + [" "]
    df = readings(spark, *texts)
    got = consensus.sample_disagreement(df).first()["mean_disagreement"]
    from test_scoring import table

    def d(a, b):
        return table(a, b)[-1][-1] / max(len(a), len(b), 1)

    pairs = [d(a, b) for i, a in enumerate(texts) for b in texts[i + 1:]]
    assert got == pytest.approx(sum(pairs) / len(pairs))
    live = [t for t in texts if t.strip()]
    sums = [round(sum(d(a, b) for j, b in enumerate(live) if j != i), 9) for i, a in enumerate(live)]
    assert consensus.medoids(df).first()["base"] == live[sums.index(min(sums))]
    assert consensus.sample_disagreement(readings(spark, "x")).first()["mean_disagreement"] == 0.0


# ---- packing and reports -----------------------------------------------------------------------------


@pytest.mark.parametrize("partitions, budget, most", [(1, 900, 7), (5, 900, 7), (24, 900, 7), (9, 10**6, 7), (40, 50, 100), (7, 900, 1)])
def test_greedy_batches_match_a_sequential_pass(spark, partitions, budget, most):
    """Ranges of any size, some shorter than a batch, give the batches of one pass."""
    df = spark.range(60).select("id", (F.col("id") * 31 % 17 + 1).alias("h"), (F.col("id") * 13 % 29 + 1).alias("w"))
    got = packing.budget_batches(df, "id", F.col("h"), F.col("w"), budget, most, partitions=partitions)
    rows = sorted(((r["h"] * r["w"], r["id"], r["h"], r["w"]) for r in df.collect()))
    want, current = [], []
    for _, key, h, w in rows:
        top = max([h, *[x[1] for x in current]]) * max([w, *[x[2] for x in current]])
        if current and ((len(current) + 1) * top > budget or len(current) >= most):
            want.append({x[0] for x in current})
            current = []
        current.append((key, h, w))
    want.append({x[0] for x in current})
    batches = {}
    for r in got.collect():
        batches.setdefault(r["batch"], set()).add(r["id"])
    assert sorted(batches) == list(range(len(want))) and [batches[b] for b in sorted(batches)] == want


def test_last_batch_of_one_may_go(spark):
    lone = spark.createDataFrame([(1, 1, 1), (2, 1, 900)], "id long, h int, w int")
    kept = packing.budget_batches(lone, "id", F.col("h"), F.col("w"), 900, 7, drop_single=True, partitions=1)
    assert ids(kept) == [1]


def test_best_epoch_ignores_nan(spark):
    df = spark.createDataFrame([("r", 1, float("nan")), ("r", 2, .5), ("r", 3, .4), ("s", 1, float("nan"))],
                               "run string, epoch int, cer double")
    got = {r["run"]: r["best_epoch"] for r in reports.best_epochs(df, "run", "epoch", "cer").collect()}
    assert got == {"r": 3, "s": None}


def test_scaling_fit_of_published_points(spark):
    points = spark.createDataFrame([(13, .7556), (52, .7189), (105, .7002)], "n int, cer double")
    fit = reports.scaling_fit(points, "n", "cer")
    got = fit.first()
    assert got["slope"] == pytest.approx(-0.0184, abs=1e-4) and got["intercept"] == pytest.approx(0.824, abs=1e-3)
    assert reports.extrapolate(fit, [1024]).first()["score"] == pytest.approx(0.824 - 0.184, abs=2e-3)


def test_null_groups_keep_their_rows(spark):
    from lekha.operators import ranking, splits

    rows = [(None if k % 4 == 0 else f"p{k % 3}", k, float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "page string, pos long, v double")
    out = splits.holdout_every(df, "page", ["pos"], 5, F.floor(F.col("pos") / 16)).collect()
    assert sorted(r["pos"] for r in out) == list(range(40))
    got = {r["page"]: (r["n"], r["p"][0]) for r in ranking.exact_percentiles(df, "v", [0.5], ["page"]).collect()}
    assert got[None] == (10, 18.0)
    assert splits.whole_pages(df, "page", "pos", 100).count() == 40


# ---- pairs of a hot key ------------------------------------------------------------------------


def test_block_pairs_are_all_pairs_once(spark):
    rows = [(f"k{i % 2}", i, f"v{i}") for i in range(120)] + [("one", 1, "x"), (None, 1, "y"), (None, 2, "z")]
    df = spark.createDataFrame(rows, "k string, i int, v string")
    for size in (4, 7, 1000):
        got = [tuple(r) for r in joins.block_pairs(df, "k", "i", ["v"], size).select("k", "i_a", "v_a", "i_b", "v_b").collect()]
        want = [(a[0], a[1], a[2], b[1], b[2]) for a in rows for b in rows if a[0] and a[0] == b[0] and a[1] < b[1]]
        assert sorted(got) == sorted(want)


def test_medoid_equals_all_pairs_from_fewer_distances(spark):
    rng = random.Random(11)
    rows = []
    for crop in range(6):
        text = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)]
        for k in range(1 if crop == 5 else 80):
            read = list(text)
            for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 90])):
                read[rng.randrange(len(read))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
            rows.append((crop, k, "".join(read)))
        rows += [(crop, 100 + k, "".join(text)) for k in range(crop)] + [(crop, 200, "  ")]
    rows += [(7, 0, " "), (8, 0, "tie a"), (8, 1, "tie b")]
    df = spark.createDataFrame(rows, "crop int, sample_idx int, text string")
    found, took = consensus.medoid_search(df)
    distances = consensus.reading_distances(consensus.distinct_readings(df)).collect()
    sums = collections.defaultdict(float)
    for r in distances:
        sums[r["crop"], r["ia"]] += r["wb"] * r["d"]
        sums[r["crop"], r["ib"]] += r["wa"] * r["d"]
    texts = {}
    for crop, k, t in rows:
        texts.setdefault((crop, t), k)
    assert {r["crop"]: r["base"] for r in consensus.medoids(df).collect()} == {r["crop"]: r["base"] for r in found.collect()}
    for r in found.collect():
        mine = {k: t for (crop, t), k in texts.items() if crop == r["crop"] and t.strip()}
        want = min(mine, key=lambda k: (round(sums[r["crop"], k], 9), k)) if mine else None
        assert r["base"] == mine.get(want, "")
    assert took < len(distances) / 5
