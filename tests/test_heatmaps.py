import numpy as np
import pytest

from tesserae.operators import heatmaps as H
from tesserae.operators import kernels as K

RNG = np.random.default_rng(4)


def scene(n=3, h=24, w=24):
    """Normal images of a stripe pattern with a little noise, and one with a mark at (8:12, 14:18)."""
    base = 0.5 + 0.1 * np.sin(np.arange(w) * 0.8)[None, None, :] + 0.0 * np.zeros((n, h, 1))
    normals = base + RNG.normal(0, 0.005, (n, h, w))
    marked = base[:1] + RNG.normal(0, 0.005, (1, h, w))
    marked[0, 8:12, 14:18] += 0.35
    return marked, normals


@pytest.mark.parametrize("kernel", [H.texture_anomaly, H.memory_heatmap, H.mutual_heatmap, H.residual_heatmap])
def test_a_mark_stands_out_against_normal_images(kernel):
    marked, normals = scene()
    heat = kernel(marked, normals)[0]
    assert heat.shape == (24, 24) and heat[8:12, 14:18].mean() > 3 * heat[:, :8].mean()
    fenced = kernel(marked, normals, box=(12, 6, 22, 20))[0]
    assert fenced[:, :12].sum() == 0 and fenced[20:].sum() == 0 and fenced[8:12, 14:18].mean() > 0.3
    alone = kernel(marked, np.zeros((0, 24, 24)))
    assert alone.shape == marked.shape and np.isfinite(alone).all()


def test_polarity():
    marked, normals = scene()
    assert H.residual_heatmap(marked, normals, polarity="bright")[0, 8:12, 14:18].mean() > 0.3
    dark = np.clip(1 - marked, 0, 1)
    assert H.texture_anomaly(dark, 1 - normals, "dark")[0, 8:12, 14:18].mean() > H.texture_anomaly(dark, 1 - normals, "bright")[0, 8:12, 14:18].mean()


def test_patch_vectors_equal_plain_loops():
    x = RNG.random((2, 9, 7))
    colour = RNG.random((2, 9, 7, 3))
    got = H.patch_vectors(x, 5, 2, colour=colour)
    contrast, edge, detail = H.texture(x)
    centres = [(y, c) for y in range(2, 7, 2) for c in range(2, 5, 2)]
    assert got.shape == (2, len(centres), 14)
    for i in range(2):
        for j, (y, c) in enumerate(centres):
            cut = lambda a: a[i, max(0, y - 2) : y + 3, max(0, c - 2) : c + 3]  # noqa: E731, B023
            rgb = cut(colour).reshape(-1, 3)
            want = [*rgb.mean(0), *rgb.std(0)] + [f(cut(a)) for a in (x, edge, detail, contrast) for f in (np.mean, np.std)]
            assert np.allclose(got[i, j], want)


def test_splat_equals_plain_loops():
    value = RNG.random((1, len(H.patch_grid(9, 9, 5, 1)[0])))
    ys, xs = H.patch_grid(9, 9, 5, 1)
    want = np.zeros((9, 9))
    for v, y, x in zip(value[0], ys, xs):
        if 2 <= x < 8 and 1 <= y < 7:
            for a in range(max(1, y - 2), min(7, y + 3)):
                for b in range(max(2, x - 2), min(8, x + 3)):
                    want[a, b] = max(want[a, b], v)
    want = H.fenced(K.gaussian(K.normalised(want[None]), 0.5), (2, 1, 8, 7))
    assert np.allclose(H.splat(value, (9, 9), 5, 1, (2, 1, 8, 7)), want)


def test_nearest_normal_and_window():
    memory = RNG.random((4, 8, 8))
    x = np.stack([memory[2] + 0.01, memory[0], memory[3]])
    index, apart = H.nearest_normal(x, memory)
    assert index.tolist() == [2, 0, 3] and np.allclose(apart, [0.01, 0, 0])
    shifted = np.roll(memory[1], (1, -2), axis=(0, 1))
    normal, dy, dx, score, window = H.best_window(shifted[None], memory, (3, 3, 6, 6), 2, 1)
    assert (normal[0], dy[0], dx[0]) == (1, -1, 2) and score[0] < 1e-9 and np.allclose(window[0], shifted[3:6, 3:6])
    assert H.nearest_normal(x, np.zeros((0, 8, 8)))[0].tolist() == [-1, -1, -1]


def test_masks_from_heat():
    heat = np.zeros((3, 10, 10))
    heat[0, 2:5, 2:5], heat[0, 8, 8], heat[1] = 0.9, 1.0, 0.3
    heat[2, 1:3, 1:3], heat[2, 6:9, 6:9] = 0.9, 0.8
    got = H.mask_from_heat(heat, percentile=90, least_area=2, most=1)
    assert got[0].sum() == 9 and got[0, 3, 3] and not got[0, 8, 8] and not got[1].any()
    assert got[2, 7, 7] and not got[2, 1, 1]  # 0.8 + .18 above 0.9 + .12
    assert H.mask_from_heat(heat[2:], 80, most=3, most_share=0.05).sum() == 5
    assert H.capped_by_heat(np.ones((1, 2, 2)), np.ones((1, 2, 2), bool), 2)[0].tolist() == [[True, True], [False, False]]


def test_fusion_of_masks_and_evidence():
    a, b, c = np.zeros((3, 1, 5, 5), bool)
    a[0, 0, 0:3], b[0, 0, 1:4], c[0, 4, 4] = True, True, True
    assert H.fused_mask(np.stack([a, b, c]), 2)[0].sum() == 2
    support = np.zeros((1, 5, 5), bool)
    support[0, 0, 0] = True
    assert H.fused_mask(np.stack([a, b, c]), 2, support)[0].sum() == 3
    assert np.allclose(H.weighted_fusion(np.array([0.5]), np.array([1.0]), np.array([0.0])), [0.56])


def test_ten_roles():
    fused = np.full((2, 9, 9), 0.1)
    fused[0, 3:6, 3:6], fused[1, 4, 4] = 0.9, 0.5
    selected = np.zeros((2, 9, 9), bool)
    selected[:, 3:6, 3:7] = True
    support = np.ones((2, 9, 9))
    r = H.mask_roles(fused, np.full((2, 9, 9), 0.2), support, selected, np.array([True, False]))
    assert len(r) == 10 and r["positive_core"][0].sum() == 9 and r["eval_tight"][0].sum() == 12
    assert r["positive_core"][1].sum() == 12 and r["eval_tight"][1].sum() == 12  # nothing sure: from the 65th percentile of the selected cells on
    assert r["training_medium"][0].sum() == 7 * 8 and r["possible_region"][0].sum() == 12
    assert np.isclose(r["training_soft"][0, 4, 4], 0.9 * 0.85) and r["training_soft"][0, 0, 0] == 0 and np.isclose(r["uncertainty_map"].max(), 0.2)


def test_changes_and_placement():
    before, after, mask = np.zeros((2, 2, 2)), np.zeros((2, 2, 2)), np.zeros((2, 2, 2), bool)
    after[0], mask[0, 0] = [[51, 51], [0, 25.5]], True
    got = H.change_measures(before, after, mask)
    assert np.allclose(got.iloc[0], [0.05, 0.2, 0.5]) and np.isnan(got["visibility"][1])
    box, refined, surface = np.ones((1, 2, 2), bool), np.zeros((1, 2, 2), bool), np.zeros((1, 2, 2), bool)
    refined[0, 0], surface[0, :, 0] = True, True
    row = H.placement_measures(box, refined, np.zeros((1, 2, 2), bool), surface).iloc[0]
    assert np.allclose(row[:6], [1.0, 0.5, 0.5, 0.5, 0.5, 0.0]) and np.isnan(row["inpaint_off_surface_fraction"])


def test_offset_bins():
    offsets = np.r_[np.full(10, 1.0), np.full(8, 9.0), [0.0, 5.0, 10.0]]
    got = H.offset_bins(offsets, 2)
    assert len(got) == 2 and got[0][0] <= 1 <= got[0][1] and got[1][0] <= 9 <= got[1][1] and H.offset_bins(offsets, 1)[0][1] < 5 and H.offset_bins(np.zeros(0), 3) == []


def test_over_a_table(spark):
    marked, normals = scene()
    rows = [(i, 24, 24, [float(v) for v in x.ravel()]) for i, x in enumerate(np.concatenate([marked, normals]))] + [(9, 24, 24, None), (10, 3, 3, [0.0])]
    df = spark.createDataFrame(rows, "id long, h int, w int, values array<double>")

    def run(ids, stack, memory):
        import pandas as pd

        heat = H.memory_heatmap(stack, memory)
        return pd.DataFrame({"id": ids, "hot": heat[:, 8:12, 14:18].mean((1, 2))})

    got = {r.id: r.hot for r in H.against_normals(df, df.filter("id between 1 and 3"), run, "id bigint, hot double").collect()}
    assert set(got) == {0, 1, 2, 3} and got[0] > 0.4
    assert H.normal_memory(df.filter("id > 100"), 4).shape[0] == 0


def test_a_failing_builder_leaves_the_others():
    from tesserae.plans.heatmaps import built_candidates

    marked, normals = scene()

    def broken(x, m):
        raise ValueError("no model")

    got = built_candidates(np.array([7]), marked, normals, {"patchcore_guided": H.memory_heatmap, "broken": broken, "nearest_normal_residual": H.residual_heatmap})
    by = {r.mode: r for r in got.itertuples()}
    assert not by["broken"].ok and by["broken"].error == "ValueError: no model" and by["patchcore_guided"].ok and by["patchcore_guided"].area > 0
    assert by["normal_residual_fusion"].area > 0 and set(by) == {"patchcore_guided", "broken", "nearest_normal_residual", "normal_residual_fusion", "support_constrained_fusion", "ensemble_consensus"}


def test_resized():
    x = RNG.random((2, 6, 4))
    assert np.allclose(K.resized(x, 6, 4), x) and np.allclose(K.resized(np.full((1, 5, 7), 0.3), 3, 9), 0.3)
    ramp = np.tile(np.arange(4.0), (1, 2, 1))
    assert np.allclose(K.resized(ramp, 2, 8)[0, 0], [0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3])


def test_windows_and_combined_masks(spark):
    from pyspark.sql import functions as F

    heat = np.zeros((1, 10, 4))
    heat[0, 6] = [0.2, 0.4, 0.6, 0.8]
    tops, scores = H.window_scores(heat, 4, 3)
    assert tops.tolist() == [0, 3, 6] and scores[0, 0] == 0
    cells = np.r_[np.zeros(12), 0.2, 0.4, 0.6, 0.8]
    assert np.isclose(scores[0, 1], 0.65 * np.percentile(cells, 98) + 0.35 * 0.8) and H.window_scores(heat, 40, 3)[1].shape == (1, 1)
    rows = [({"a": [1, 1, 0], "b": [0, 1, 0]},), ({"a": [1, 0, 0]},), ({"a": [1, 0], "b": [0, 1]},), (None,)]
    df = spark.createDataFrame(rows, "m map<string, array<int>>")
    got = df.select(H.combined_mask(F.col("m"), ["a", "b"], "union").alias("u"), H.combined_mask(F.col("m"), ["a", "b"], "intersection").alias("i")).collect()
    assert [(r.u, r.i) for r in got] == [([1, 1, 0], [0, 1, 0]), (None, None), ([1, 1], None), (None, None)]
    with pytest.raises(ValueError):
        H.combined_mask(F.col("m"), ["a"], "difference")
