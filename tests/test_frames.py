"""Frame analytics on small hand-made lines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lekha.functions.alignment import best_labellings, frames_needed
from lekha.functions.codec import KANNADA
from lekha.operators import forced, frames as fr, reports
from lekha.tables import FRAMES

C = 57


def vector(**probs):
    p = np.full(C, 1e-9)
    for symbol, value in probs.items():
        p[0 if symbol == "blank" else KANNADA.index(symbol)] = value
    return np.log(p).tolist()


def lines(spark, **by_line):
    rows = [(int(k[1:]), t, v) for k, vs in by_line.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, FRAMES)


def slots(df, **kw):
    return sorted(fr.line_slots(df, **kw).collect(), key=lambda r: (r["line_id"], r["slot"]))


def test_repeats_collapse_blanks_drop_and_separate(spark):
    df = lines(spark, l1=[vector(blank=.9), vector(k=.9), vector(k=.8), vector(blank=.9), vector(k=.9), vector(a=.9)],
               l2=[vector(blank=.9)])
    got = {r["line_id"]: r["indices"] for r in fr.greedy_decode(df).collect()}
    k, a = KANNADA.index("k"), KANNADA.index("a")
    assert got == {1: [k, k, a], 2: []}


@pytest.mark.parametrize("chunk", [1, 2, 3, 4096])
def test_runs_do_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(0)
    rows = [(line, t, int(c)) for line in range(6) for t, c in enumerate(rng.integers(0, 3, 25).repeat(2))]
    df = spark.createDataFrame(rows, "line_id int, frame int, label int")
    weight = F.pmod(F.col("frame") * 7, F.lit(5)).cast("double")
    got = {(r.line_id, r.first, r.last, r.label, r.slot, r.peak) for r in
           fr.runs(df, "label", weight=weight, chunk=chunk).collect()}
    want = set()
    for line in range(6):
        labels = [c for ln, _, c in rows if ln == line]
        start, slot = 0, 0
        for t in range(1, len(labels) + 1):
            if t == len(labels) or labels[t] != labels[start]:
                span = range(start, t)
                peak = max(span, key=lambda u: (u * 7 % 5, -u))
                want.add((line, start, t - 1, labels[start], slot if labels[start] else None, peak))
                slot += labels[start] != 0
                start = t
    assert got == want


def test_a_slot_reports_its_surest_frame(spark):
    """The frame with the greatest weight speaks for a run, wherever it stands."""
    rng = np.random.default_rng(11)
    weights = rng.permutation(np.linspace(.61, .97, 9))
    (slot,) = slots(lines(spark, l1=[vector(p=w, P=1 - w) for w in weights]))
    assert slot["frame"] == int(np.argmax(weights))
    assert slot["top1"] == pytest.approx(weights.max(), abs=1e-3)


def test_variants_swap_one_slot_at_a_time(spark):
    sure, torn = vector(m=.97), vector(t=.62, T=.38)
    df = lines(spark, l1=[sure, torn, sure, torn], l2=[sure])
    variants = fr.variant_readings(fr.line_slots(df)).collect()
    main = {r["line_id"]: r["text"] for r in variants if r["rank"] == 0}
    rivals = [r["text"] for r in variants if r["line_id"] == 1 and r["rank"] > 0]
    assert len(main) == 2 and len(rivals) == 2
    assert all(sum(a != b for a, b in zip(main[1], r)) == 1 for r in rivals)
    assert not [r for r in variants if r["line_id"] == 2 and r["rank"] > 0]


@pytest.mark.parametrize("hotter", [1.5, 3.0, 8.0])
def test_a_higher_temperature_flattens(spark, hotter):
    df = lines(spark, l1=[vector(r=.7, R=.3)])
    assert slots(df, temperature=hotter)[0]["top1"] < slots(df)[0]["top1"]


def test_blend_pool_and_mask(spark):
    df = lines(spark, l1=[vector(k=.9, blank=.1), vector(blank=.99), vector(k=1.0)])
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(C)], "index int, vector array<double>")
    cold = sorted(fr.blend_embeddings(df, table, 0.01).collect(), key=lambda r: r["frame"])
    k = float(KANNADA.index("k"))
    assert [r["vector"][0] for r in cold] == pytest.approx([k, 0, k], abs=1e-3)
    assert [r["masked"] for r in cold] == [False, True, False]
    assert not any(r["masked"] for r in fr.blend_embeddings(df, table, 1.0, blank_drop=None).collect())
    pooled = sorted(fr.pool_frames(fr.blend_embeddings(df, table, 0.01), 2).collect(), key=lambda r: r["pooled"])
    assert len(pooled) == 2 and pooled[1]["vector"][1] == pytest.approx(0.5)  # zeros of the short tail count
    assert [r["masked"] for r in pooled] == [False, False]


def test_statistics(spark):
    df = lines(spark, l1=[vector(k=.95), vector(k=.5)], l2=[vector(k=.999)])
    got = fr.confidence_statistics(df).first()
    assert got["n_frames"] == 3 and got["mean_top1"] == pytest.approx((.95 + .5 + .999) / 3)
    assert got["below_90"] == pytest.approx(1 / 3) and got["below_99"] == pytest.approx(2 / 3)
    flags = {r["line_id"]: r["flagged"] for r in fr.flag_lines(fr.line_confidence(df), .9).collect()}
    assert flags == {1: True, 2: False}


def every_path(lp, targets):
    """Best score over all labellings that read as the targets."""
    states = [0] + [s for t in targets for s in (t, 0)]
    best = {}

    def walk(t, s, score):
        score += lp[t][states[s]]
        if t == len(lp) - 1:
            if s >= len(states) - 2:
                best[score] = True
            return
        for step in (0, 1, 2):
            n = s + step
            if n < len(states) and (step < 2 or (states[n] and states[n] != states[s])):
                walk(t + 1, n, score)

    walk(0, 0, 0.0)
    walk(0, 1, 0.0)
    return max(best)


def test_best_labellings_of_a_block_of_lines():
    rng = np.random.default_rng(3)
    wanted = [[1, 2], [1, 1], [2], [3, 1, 3], [], [2, 2, 2]]
    lps = [np.log(rng.dirichlet(np.ones(4), n)).astype(np.float32) for n in (7, 3, 6, 8, 4, 4)]
    got = best_labellings([(t, lp[:, [0, *t]]) for t, lp in zip(wanted, lps)])
    for targets, lp, labels in zip(wanted, lps, got):
        if not targets or len(lp) < frames_needed(targets):
            assert labels is None
            continue
        assert sum(lp[t, c] for t, c in enumerate(labels)) == pytest.approx(every_path(lp.tolist(), targets), abs=1e-4)
        assert [int(c) for i, c in enumerate(labels) if c and (i == 0 or labels[i - 1] != c)] == targets


def test_forced_alignment_rejects_short_lines(spark):
    df = lines(spark, l1=[vector(k=.9), vector(a=.9)], l2=[vector(k=.9)] * 2, l3=[vector(k=.9)])
    k, a = KANNADA.index("k"), KANNADA.index("a")
    targets = spark.createDataFrame([(1, [k, a]), (2, [k, k]), (3, [])], "line_id long, targets array<int>")
    got = {}
    for r in forced.forced_align(df, targets).collect():
        got.setdefault(r["line_id"], []).append((r["frame"], r["label"]))
    assert sorted(got[1]) == [(0, k), (1, a)] and got[2] == [(None, None)] and got[3] == [(None, None)]
    spans = forced.label_spans(forced.forced_align(df, targets), targets).orderBy("slot").collect()
    assert [(s["line_id"], s["label"], s["first"], s["last"]) for s in spans] == [(1, k, 0, 0), (1, a, 1, 1)]


def test_recovery_scan(spark):
    df = lines(spark, l1=[vector(x=.6, X=.4), vector(a=.99)])
    X, a = KANNADA.index("X"), KANNADA.index("a")
    targets = spark.createDataFrame([(1, [X, a])], "line_id long, targets array<int>")
    scan = forced.recovery_scan(df, forced.forced_align(df, targets), 1.0)
    total = forced.recovery_totals(scan).first()
    assert total[:3] == (2, 1, 1) and total["mean_weight"] == pytest.approx(.4, abs=1e-3)
    best = forced.top_examples(scan, 3).collect()
    assert len(best) == 1 and best[0]["rank"] == 2 and math.isclose(best[0]["truth_confidence"], .4, abs_tol=1e-3)


def test_lines_of_every_outcome_are_counted(spark):
    """Aligned, unencodable (null, a null symbol, an unknown class), unalignable (no symbols, too many, no frames), mismatched."""
    rows = [(line, t, [0.0, 0.0, 0.0]) for line in range(7) for t in range(3)]
    df = spark.createDataFrame(rows, "line_id long, frame int, log_probs array<double>")
    targets = spark.createDataFrame([(0, [1, 2]), (1, None), (2, [1, None]), (3, [1, 7]), (4, []), (5, [1, 1, 1]), (6, [1]), (9, [1])],
                                    "line_id long, targets array<int>")
    labels = forced.forced_align(df, targets)
    status = {r["line_id"]: r["status"] for r in labels.collect()}
    assert status == {0: "aligned", 1: "unencodable", 2: "unencodable", 3: "unencodable", 4: "unalignable", 5: "unalignable", 6: "aligned", 9: "unalignable"}
    totals = forced.recovery_totals(forced.recovery_scan(df, labels, 1.0)).first()
    assert totals["unencodable"] == 3 and totals["unalignable"] == 3 and totals["aligned_frames"] >= 3
    lost = labels.withColumn("label", F.when(F.col("line_id") == 6, 0).otherwise(F.col("label")))
    outcomes = forced.line_outcomes(lost, targets)
    assert {r["line_id"]: r["status"] for r in outcomes.collect()} == {**status, 6: "mismatched"}
    widths = spark.createDataFrame([(0, 24), (6, 24)], "line_id long, width int")
    cuts = forced.cut_bounds(forced.label_spans(lost, targets), widths)
    report = forced.glyph_outcomes(cuts, outcomes).first()
    assert (report["lines"], report["lines_aligned"], report["lines_unencodable"], report["lines_unalignable"], report["lines_mismatched"]) == (8, 1, 3, 3, 1)
    assert report["glyphs_kept"] + report["glyphs_empty"] + report["glyphs_too_wide"] == 2
    kept = {r["line_id"]: (r["n_targets"], r["n_kept"]) for r in forced.glyph_yield(cuts, outcomes).collect()}
    assert kept[9] == (1, 0) and kept[0] == (2, report["glyphs_kept"]) and len(kept) == 8


def test_readable_recoveries_are_filtered_and_ordered(spark):
    rows = [("none", 0, 1, .01, 9), ("many", 1, 7, .01, 9), ("far", 1, 1, .2, 9), ("long", 1, 1, .01, 221),
            ("b", 1, 6, .15, 220), ("c", 2, 3, .15, 9), ("a", 1, 1, .01, 9)]
    df = spark.createDataFrame(rows, "line_id string, recoveries int, substitutions int, cer double, n_chars int")
    assert [r["line_id"] for r in reports.readable_recoveries(df).collect()] == ["a", "c", "b"]
