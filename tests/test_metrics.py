import random

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import kernels as K
from tesserae.operators import ladders as L
from tesserae.operators import metrics as M
from tesserae.operators import quantiles as Q
from tesserae.operators import vector as V
from tesserae.operators.raster import map_rasters, soft_entropy


def _ladder(spark, pairs):
    df = spark.createDataFrame([(float(s) if s is not None else None, t, 1.0, 2) for s, t in pairs], "s double, t boolean, score double, pos int")
    return L.ladder(df, [], F.col("s"), F.col("t"))


def test_ranking_metrics_equal_brute_force(spark):
    rnd = random.Random(9)
    pairs = [(rnd.choice([rnd.random(), 0.5, 0.25]), rnd.random() < 0.3) for _ in range(400)]
    rungs = _ladder(spark, pairs + [(None, True), (float("nan"), True), (0.3, None)])
    p, n = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    want = sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n)
    assert abs(L.auroc(rungs, []).first().auroc - want) < 1e-12
    steps = [(sum(x == s for x in p), sum(x >= s for x in p), sum(x >= s for x, _ in pairs)) for s in {x for x, _ in pairs}]
    assert abs(L.average_precision(rungs, []).first().average_precision - sum(a * b / c for a, b, c in steps) / len(p)) < 1e-12


def test_ties_and_single_class(spark):
    assert L.auroc(_ladder(spark, [(0.5, True)] * 2 + [(0.5, False)] * 2), []).first().auroc == 0.5
    assert L.auroc(_ladder(spark, [(0.5, True)]), []).first().auroc is None
    assert L.auroc(_ladder(spark, []), []).first().auroc is None


def test_threshold_leaves_the_flooding_one(spark):
    df = spark.createDataFrame([(0.6 if i == 0 else 0.5, i == 0) for i in range(100)], "s double, t boolean")
    thresholds = M.threshold_candidates(df, "s", [0.05, 0.55])
    sweep = M.threshold_sweep(df, "s", "t", thresholds)
    for r in sweep.collect():
        hit = [(0.6 if i == 0 else 0.5) >= r.threshold for i in range(100)]
        assert (r.tp, r.fp) == (int(hit[0]), sum(hit[1:])) and r.tp + r.fp + r.fn + r.tn == 100
    best = M.best_threshold(sweep, 0.0, 0.01, 0.001, 0.2).first()
    assert best.threshold > 0.5 and best.rate <= 0.2 and best.satisfied


def test_calibration_fusion_and_means(spark):
    one = spark.range(1).select(
        M.calibrated(F.lit(0.6), F.lit(0.5), F.lit(1.0), 2.0), M.calibrated(F.lit(0.6), F.lit(0.5), F.lit(0.5), 2.0), M.fused_log_odds([F.lit(0.9), F.lit(0.9)], [F.lit(1.0), F.lit(0.0)])[0]
    ).first()
    assert abs(one[0] - 0.04) < 1e-12 and one[1] == 0 and abs(one[2] - 0.9) < 1e-9
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("b", float("nan"))], "g string, v double")
    assert {r.g: r.m for r in df.groupBy("g").agg(M.mean_of_known(F.col("v")).alias("m")).collect()} == {"a": 1.0, "b": None}


def test_bootstrap_covers_the_mean(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(f"g{i % 8}", rnd.gauss(5, 1), i) for i in range(800)], "g string, v double, n int")
    row = M.bootstrap_interval(df, "g", "v", "n", 100).first()
    assert row.low < 5 < row.high and row.high - row.low < 0.6
    assert M.bootstrap_interval(df, "g", "v", "n", 100).first() == row


def test_bootstrap_takes_a_thousand_rounds(spark):
    df = spark.createDataFrame([(f"g{i % 4}", float(i * 7 % 31), i) for i in range(60)], "g string, v double, n int")
    row = M.bootstrap_interval(df, "g", "v", "n").first()
    assert row == M.bootstrap_interval(df, "g", "v", "n", 1000).first() != M.bootstrap_interval(df, "g", "v", "n", 200).first()


def test_bootstrap_is_hierarchical(spark):
    # groups far apart, rows alike: the interval is that of redrawn groups
    df = spark.createDataFrame([(f"g{i % 5}", float(i % 5), i) for i in range(500)] + [(None, 9.0, 1000), ("g1", None, 1001)], "g string, v double, n int")
    row = M.bootstrap_interval(df, "g", "v", "n").first()
    rng = np.random.default_rng(0)
    want = np.quantile(rng.integers(0, 5, (20000, 5)).mean(axis=1), [0.025, 0.975])
    assert abs(row.mean - 2) < 0.1 and abs(row.low - want[0]) <= 0.2 and abs(row.high - want[1]) <= 0.2
    lone = M.bootstrap_interval(spark.createDataFrame([("a", 1.0, 1), ("b", 3.0, 2)], "g string, v double, n int"), "g", "v", "n").first()
    assert (lone.low, lone.high) == (1.0, 3.0)
    assert M.bootstrap_interval(df.limit(0), "g", "v", "n").count() == 0


def test_order_statistics_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(Q, "BINS", 8)
    sets = {"a": rng.normal(size=301), "b": np.r_[np.full(50, 2.0), 1e300, -1e300, rng.normal(size=40)], "c": np.array([7.0]), None: rng.integers(0, 3, 77).astype(float), "d": np.full(9, -0.5)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in sets.items() for v in vs] + [("a", None), ("a", float("nan")), ("empty", None)], "g string, v double")
    parts = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r.g: r for r in Q.exact_quantiles(df, ["g"], "v", parts).collect()}
    assert set(got) == set(sets)
    for g, vs in sets.items():
        assert got[g].n == len(vs) and np.allclose(got[g].q, np.quantile(vs, parts), rtol=1e-12)
    whole = np.concatenate(list(sets.values()))
    assert np.allclose(Q.exact_quantiles(df, [], "v", parts).first().q, np.quantile(whole, parts), rtol=1e-12)
    assert Q.exact_quantiles(df.limit(0), [], "v", parts).count() == 0
    low = {r.g: r for r in M.worst_quartile(df, ["g"], "v").collect()}
    for g, vs in sets.items():
        assert np.isclose(low[g].worst_quartile, np.sort(vs)[: max(1, len(vs) // 4)].mean(), rtol=1e-9) and low[g].worst == vs.min()


def test_calibrated_bound_equals_pooling_by_hand(spark):
    rows = [(0.1, 0.0), (0.2, 1.0), (0.3, 0.0), (0.6, 1.0), (0.9, 1.0), (0.95, None), (None, 1.0)]
    got = {r.p: (r.calibrated, r.lower) for r in M.calibrated_bound(spark.createDataFrame(rows, "p double, y double"), "p", "y").collect()}
    # 1 and 0 at 0.2 and 0.3 are pooled to a half; overshoots are 0, 0, .5, 0, 0 and their 0.9 quantile .3
    assert [got[p][0] for p in (0.1, 0.2, 0.3, 0.6, 0.9, 0.95)] == [0.0, 0.5, 0.5, 1.0, 1.0, 1.0] and got[None] == (None, 0.0) or got[None][0] is None
    assert np.allclose([got[p][1] for p in (0.1, 0.2, 0.6)], [0.0, 0.2, 0.7])


def test_gate(spark):
    row = spark.createDataFrame([(0.55, 0.30, 0.90, 0.75, 0.05), (0.9, 0.9, 0.9, 0.9, 0.06), (0.9, None, 0.9, 0.9, 0.0)], "macro_dice double, worst_dice double, recall double, coverage double, regret double")
    assert [r.go for r in M.gate(row).collect()] == [True, False, False]


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_VECTORS", 30)
    x = np.random.default_rng(0).normal(size=(120, 5))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = {}
    for r in V.nearest(df, df, 3, "euclid", not_itself=True).collect():
        got.setdefault(r.id, []).append((r.nth, r.neighbour))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(120):
        want = [j for j in np.argsort(d[i], kind="stable") if j != i][:3]
        assert [j for _, j in sorted(got[i])] == want
    assert V.nearest(df, df.limit(0), 3).count() == 0


def _components(mask, eight):
    h, w = mask.shape
    out = np.full((h, w), -1)
    for start in range(h * w):
        if mask.flat[start] and out.flat[start] < 0:
            todo = [start]
            out.flat[start] = start
            while todo:
                y, x = divmod(todo.pop(), w)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if (dy or dx) and (eight or not (dy and dx)) and 0 <= y + dy < h and 0 <= x + dx < w and mask[y + dy, x + dx] and out[y + dy, x + dx] < 0:
                            out[y + dy, x + dx] = start
                            todo.append((y + dy) * w + x + dx)
    return out


def test_components_equal_flood_fill():
    masks = np.random.default_rng(3).random((40, 9, 7)) < 0.55
    for eight in (False, True):
        got = K.components(masks, eight)
        assert all((got[i] == _components(masks[i], eight)).all() for i in range(40))


def test_kernels_on_plain_cases():
    truth = np.zeros((1, 8, 8), bool)
    truth[0, 2:5, 2:5] = True
    assert K.aupro(truth.astype(float), truth)[0] > 0.99
    assert np.isnan(K.aupro(truth.astype(float), np.zeros_like(truth))[0])
    assert (K.erode(K.dilate(truth)) == truth).all() and K.dilate(truth).sum() == 25
    flat = np.ones((2, 8, 8))
    assert np.allclose(K.box_blur(flat), 1) and not K.structure_ridge(flat).any() and np.allclose(K.gaussian(flat, 1.0), 1)
    stripes = np.tile(np.sin(np.arange(32) * np.pi / 2), (1, 32, 1)) + np.zeros((1, 32, 32))
    spot = stripes.copy()
    spot[0, 16, 16] += 3
    cleaned = K.fft_notch(spot)
    assert np.unravel_index(cleaned[0].argmax(), (32, 32)) == (16, 16)
    assert list(K.greedy_windows(np.array([1.0, 3.0, 2.0, 3.0]), np.array([0.0, 1.0, 1.5, 5.0]), 1.0, 3)) == [0, 1, 3]


def test_rasters_of_odd_shape_are_left_out(spark):
    df = spark.createDataFrame([(1, 2, 2, [1.0, 2.0, 3.0, float("nan")]), (2, 2, 2, [1.0]), (3, 2, 2, None), (4, 1, 3, [1.0, 2.0, 3.0])], "id long, h int, w int, values array<double>")
    import pandas as pd

    out = map_rasters(df, lambda ids, s: pd.DataFrame({"id": ids, "total": s.sum((1, 2))}), "id long, total double")
    assert {r.id: r.total for r in out.collect()} == {1: 6.0, 4: 6.0}
    assert spark.range(1).select(soft_entropy(F.array(F.lit(0.0), F.lit(1.0)))).first()[0] == 0.0


def test_generic_proposals_are_whole():
    score = np.zeros((20, 20))
    score[2:8, 3:9], score[12:15, 10:14], score[18, 18] = 0.9, 0.6, 0.95
    got = {mode: (mask, m) for mode, mask, m in K.generic_proposals(score)}
    assert list(got) == ["fused_q850", "fused_q850_component_1", "fused_q850_component_2"]
    mask, m = got["fused_q850"]
    assert mask.sum() == 48 and m["component_count"] == 2 and m["area_fraction"] == 0.12 and m["boundary_contact"] == 0
    mask, m = got["fused_q850_component_2"]
    assert (mask.sum(), m["compactness"], round(m["elongation"], 6), round(m["evidence_coverage"], 6)) == (12, 1.0, 1.333333, 0.6)
    assert any(mode.startswith("fused_q975") for mode, _, _ in K.generic_proposals(np.arange(400.0).reshape(20, 20) / 400))
