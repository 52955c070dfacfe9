"""Heatmaps of images against images known to be normal, and masks out of heatmaps.

Kernels take stacks (n, h, w) of grey values between 0 and 1 and a memory of
normal images (m, h, w). ``against_normals`` runs one over a table; the memory
is the ``most`` first normal images by id, a bound that belongs to the method,
and goes to the executors once.

Defined cases: without normal images the texture map is that of the image by
itself, all others are 0; constant maps are 0; cells outside the fence are 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import kernels as K
from tesserae.operators.raster import map_rasters

#: Weights of contrast, edge and detail; of fine and coarse residual; of density in the mutual score. Fixed values.
TEXTURE_WEIGHTS = (0.40, 0.35, 0.25)
RESIDUAL_WEIGHTS = (0.62, 0.38)
TEXTURE_MATCH = 0.20
MUTUAL_BASE, MUTUAL_DENSITY = 0.78, 0.22
ONE_SIDED = 0.35


def normal_memory(normals: DataFrame, most: int) -> np.ndarray:
    """(m, h, w) of the ``most`` first normal images of one size; bounded by ``most``."""
    rows = normals.select("id", "h", "w", "values").orderBy("id").limit(most).toPandas()
    if not len(rows):
        return np.zeros((0, 1, 1))
    h, w = int(rows["h"].iloc[0]), int(rows["w"].iloc[0])
    return np.stack([np.asarray(v, float).reshape(h, w) for v, a, b in zip(rows["values"], rows["h"], rows["w"]) if (a, b) == (h, w)])


def against_normals(images: DataFrame, normals: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, most: int = 8) -> DataFrame:
    """``kernel(ids, stack, memory)`` over all images."""
    shared = images.sparkSession.sparkContext.broadcast(normal_memory(normals, most))
    return map_rasters(images, lambda ids, stack: kernel(ids, stack, shared.value), schema)


def one_sided(over: np.ndarray, under: np.ndarray, polarity: str) -> np.ndarray:
    """What stands out darker, brighter or either way."""
    return {"dark": under, "bright": over}.get(polarity, np.maximum(over, under))


def texture(x: np.ndarray, polarity: str = "absolute") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contrast to the wide surroundings, edges, detail against the near ones)."""
    wide = K.gaussian(x, 8.0)
    contrast = one_sided(np.maximum(x - wide, 0), np.maximum(wide - x, 0), polarity)
    dx, dy = np.zeros_like(x), np.zeros_like(x)
    dx[:, :, 1:], dy[:, 1:, :] = np.diff(x, axis=2), np.diff(x, axis=1)
    return contrast, np.hypot(dx, dy), np.abs(x - K.gaussian(x, 2.0))


def fenced(heat: np.ndarray, box: tuple[int, int, int, int] | None) -> np.ndarray:
    """0 outside the half-open box."""
    if box is None:
        return heat
    out = np.zeros_like(heat)
    x1, y1, x2, y2 = box
    out[:, y1:y2, x1:x2] = heat[:, y1:y2, x1:x2]
    return out


def texture_anomaly(x: np.ndarray, memory: np.ndarray, polarity: str = "absolute", box: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """How far contrast, edges and detail lie above what the normal images have, in robust deviations."""
    heat = np.zeros_like(x)
    known = texture(memory, polarity) if len(memory) else [None] * 3
    for weight, own, normal in zip(TEXTURE_WEIGHTS, texture(x, polarity), known):
        if normal is not None:
            middle = np.median(normal)
            own = np.maximum((own - middle) / (1.4826 * (np.median(np.abs(normal - middle)) + 1e-6)), 0)
        heat += weight * K.normalised(own)
    return fenced(heat, box)


def patch_grid(h: int, w: int, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of patch centres that keep half a patch from the border where there is room."""
    half = size // 2
    ys, xs = np.arange(half, max(half + 1, h - half), stride), np.arange(half, max(half + 1, w - half), stride)
    return np.repeat(ys, len(xs)), np.tile(xs, len(ys))


def patch_vectors(x: np.ndarray, size: int = 5, stride: int = 1, polarity: str = "absolute", colour: np.ndarray | None = None) -> np.ndarray:
    """(n, patches, 14): mean and deviation of three colours, brightness, edges, detail and contrast of every patch.

    ``colour`` is (n, h, w, 3); grey images have three equal colours. A patch is
    cut off at the border.
    """
    contrast, edge, detail = texture(x, polarity)
    colours = [x, x, x] if colour is None else [colour[..., c] for c in range(3)]
    ys, xs = patch_grid(x.shape[1], x.shape[2], size, stride)
    half = size // 2

    def moments(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # sums over squares of cells from two summed-area tables
        table = lambda v: np.pad(v.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
        y1, y2 = np.maximum(ys - half, 0), np.minimum(ys + half + 1, a.shape[1])
        x1, x2 = np.maximum(xs - half, 0), np.minimum(xs + half + 1, a.shape[2])
        count = ((y2 - y1) * (x2 - x1)).astype(float)
        within = lambda t: t[:, y2, x2] - t[:, y1, x2] - t[:, y2, x1] + t[:, y1, x1]
        mean = within(table(a)) / count
        return mean, np.sqrt(np.maximum(within(table(a * a)) / count - mean**2, 0))

    parts = [moments(c) for c in colours]
    rest = [v for a in (x, edge, detail, contrast) for v in moments(a)]
    return np.stack([*[m for m, _ in parts], *[s for _, s in parts], *rest], axis=-1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b``."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def _standard(x: np.ndarray, memory: np.ndarray, size: int, stride: int, polarity: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    known = patch_vectors(memory, size, stride, polarity).reshape(-1, 14)
    if len(known) > most:
        known = known[np.linspace(0, len(known) - 1, most).astype(int)]
    mean, deviation = known.mean(axis=0), known.std(axis=0) + 1e-6
    return (patch_vectors(x, size, stride, polarity) - mean) / deviation, (known - mean) / deviation


def splat(value: np.ndarray, shape: tuple[int, int], size: int, stride: int, box: tuple[int, int, int, int] | None) -> np.ndarray:
    """Patch values (n, patches) as maps: a cell has the greatest of the patches over it with a centre inside the box, blurred and fenced."""
    h, w = shape
    x1, y1, x2, y2 = box or (0, 0, w, h)
    ys, xs = patch_grid(h, w, size, stride)
    out, half = np.zeros((len(value), h, w)), size // 2
    for i in np.flatnonzero((ys >= y1) & (ys < y2) & (xs >= x1) & (xs < x2)):
        part = np.s_[:, max(y1, ys[i] - half) : min(y2, ys[i] + half + 1), max(x1, xs[i] - half) : min(x2, xs[i] + half + 1)]
        out[part] = np.maximum(out[part], value[:, i, None, None])
    return fenced(K.gaussian(K.normalised(out), max(0.5, stride / 3)), box)


def memory_heatmap(x: np.ndarray, memory: np.ndarray, size: int = 5, stride: int = 1, polarity: str = "absolute", box: tuple[int, int, int, int] | None = None, most_patches: int = 4096) -> np.ndarray:
    """Distance of every patch to its nearest normal one."""
    if not len(memory):
        return np.zeros_like(x)
    own, known = _standard(x, memory, size, stride, polarity, most_patches)
    return splat(np.stack([distances(v, known).min(axis=1) for v in own]), x.shape[1:], size, stride, box)


def mutual_heatmap(x: np.ndarray, memory: np.ndarray, size: int = 5, stride: int = 1, k: int = 3, polarity: str = "absolute", box: tuple[int, int, int, int] | None = None, most_patches: int = 4096) -> np.ndarray:
    """Mean distance to the ``k`` nearest normal patches, more so where the image's own patches lie close together."""
    if not len(memory):
        return np.zeros_like(x)
    own, known = _standard(x, memory, size, stride, polarity, most_patches)
    unit = lambda v: (v - v.min()) / (v.max() - v.min()) if v.max() > v.min() else np.zeros_like(v)
    out = []
    for v in own:
        near = np.sort(distances(v, known), axis=1)[:, : min(k, len(known))].mean(axis=1)
        among = np.sort(distances(v, v), axis=1)[:, 1 : min(max(2, k + 1), len(v))]
        density = among.mean(axis=1) if among.shape[1] else np.zeros(len(v))
        out.append(unit(near) * (MUTUAL_BASE + MUTUAL_DENSITY * (1 - unit(density))))
    return splat(np.stack(out), x.shape[1:], size, stride, box)


def nearest_normal(x: np.ndarray, memory: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, mean absolute difference) of each image's nearest normal one; the first of equal ones."""
    apart = np.stack([np.abs(x - m).mean(axis=(1, 2)) for m in memory], axis=1) if len(memory) else np.zeros((len(x), 0))
    if not apart.shape[1]:
        return np.full(len(x), -1), np.full(len(x), np.nan)
    return apart.argmin(axis=1), apart.min(axis=1)


def best_window(x: np.ndarray, memory: np.ndarray, box: tuple[int, int, int, int], radius: int, step: int) -> tuple[np.ndarray, ...]:
    """(normal, dy, dx, score, window) of the normal window most like the box of each image, over all normals and offsets.

    Windows stay inside the image; scored by coarse difference and by how unlike the deviations of fine detail are.
    """
    x1, y1, x2, y2 = box
    h, w = x.shape[1:]
    offsets = sorted({*range(-radius, radius + 1, max(1, step)), 0})
    own = x[:, y1:y2, x1:x2]
    coarse = K.gaussian(own, 3.0)
    fine = (own - coarse).std(axis=(1, 2))
    best = np.full(len(x), np.inf)
    at = np.zeros((len(x), 3), int)
    window = np.zeros_like(own)
    for i, normal in enumerate(memory):
        for dy in offsets:
            for dx in offsets:
                top, left = min(max(0, y1 + dy), h - (y2 - y1)), min(max(0, x1 + dx), w - (x2 - x1))
                other = normal[top : top + y2 - y1, left : left + x2 - x1]
                low = K.gaussian(other[None], 3.0)[0]
                score = np.abs(coarse - low).mean(axis=(1, 2)) + TEXTURE_MATCH * np.abs(fine - (other - low).std())
                better = score < best
                best[better], at[better], window[better] = score[better], (i, dy, dx), other
    return at[:, 0], at[:, 1], at[:, 2], best, window


def residual_heatmap(x: np.ndarray, memory: np.ndarray, box: tuple[int, int, int, int] | None = None, radius: int = 2, step: int = 1, polarity: str = "absolute") -> np.ndarray:
    """Difference to the most similar normal window, fine and coarse."""
    if not len(memory):
        return np.zeros_like(x)
    x1, y1, x2, y2 = box = box or (0, 0, x.shape[2], x.shape[1])
    window = best_window(x, memory, box, radius, step)[4]
    own = x[:, y1:y2, x1:x2]
    fine = np.abs((own - K.gaussian(own, 3.0)) - (window - K.gaussian(window, 3.0)))
    local = np.abs(own - window)
    if polarity != "absolute":
        local = np.maximum(ONE_SIDED * local, np.maximum(window - own if polarity == "dark" else own - window, 0))
    both = K.normalised(RESIDUAL_WEIGHTS[0] * K.normalised(fine) + RESIDUAL_WEIGHTS[1] * K.normalised(local))
    out = np.zeros_like(x)
    out[:, y1:y2, x1:x2] = K.normalised(K.gaussian(both, 0.75))
    return out


def capped_by_heat(heat: np.ndarray, mask: np.ndarray, most: int) -> np.ndarray:
    """The mask's ``most`` hottest cells; of equal ones the first by position."""
    flat = np.where(mask, heat, -np.inf).reshape(len(heat), -1)
    order = np.argsort(-flat, axis=1, kind="stable")[:, :most]
    out = np.zeros(flat.shape, bool)
    np.put_along_axis(out, order, True, axis=1)
    return out.reshape(mask.shape) & mask


def mask_from_heat(heat: np.ndarray, percentile: float = 90.0, fallback: float = 8.0, gate: float = 0.0, least_area: int = 2, most: int = 3, most_share: float = 0.5) -> np.ndarray:
    """Cells above a percentile, closed, without small components, the ``most`` best of the others, capped by share of the image.

    No mask where the heat's 95th percentile is not above its median by ``gate``; a percentile that leaves nothing is
    lowered once by ``fallback``. Components are ranked by mean heat and, up to 0.18, three times their share of the image.
    """
    out = np.zeros(heat.shape, bool)
    for i, image in enumerate(heat):
        if np.percentile(image, 95) - np.percentile(image, 50) <= gate:
            continue
        for p in (percentile, max(0.0, percentile - fallback)):
            mask = K.close((image >= np.percentile(image, p))[None], 3)
            label = K.components(mask, True)[0]
            sizes = {c: int((label == c).sum()) for c in np.unique(label[label >= 0])}
            kept = [c for c, n in sizes.items() if n >= least_area]
            if kept:
                rank = lambda c: (-(image[label == c].mean() + min(0.18, 3 * sizes[c] / image.size)), c)  # noqa: E731, B023
                best = np.isin(label, sorted(kept, key=rank)[:most])
                out[i] = capped_by_heat(image[None], best[None], max(1, int(most_share * image.size)))[0]
                break
    return out


def fused_mask(masks: np.ndarray, least_votes: int, support: np.ndarray | None = None) -> np.ndarray:
    """Cells of at least ``least_votes`` masks (k, n, h, w), and of single masks where they touch the support; nothing where no mask has any."""
    votes = masks.sum(axis=0)
    out = votes >= least_votes
    if support is not None:
        label = [K.components(m, True) for m in masks]
        for l, m in zip(label, masks):
            for i in range(len(m)):
                touched = np.unique(l[i][m[i] & support[i]])
                out[i] |= np.isin(l[i], touched[touched >= 0])
    return out


def combined_mask(masks: Column, modes: list[str], operation: str) -> Column:
    """Union or intersection of the masks of all ``modes`` out of a map from mode to mask; null if one is missing or nothing is left."""
    join = {"union": lambda a, b: F.greatest(a, b), "intersection": lambda a, b: F.least(a, b)}
    if operation not in join or not modes:
        raise ValueError(f"cannot combine {modes} by {operation}")
    parts = [F.try_element_at(masks, F.lit(m)) for m in modes]
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, join[operation])  # null if either is
    return F.when(F.exists(out, lambda v: v > 0), out)


#: A window's score: its 98th percentile and the mean of its hottest twentieth. Fixed values.
WINDOW_WEIGHTS, WINDOW_PERCENTILE, WINDOW_PART = (0.65, 0.35), 98.0, 20


def window_scores(heat: np.ndarray, height: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(tops, scores (n, windows)) of windows of full width slid down each image; one window if the image is lower than it."""
    tops = np.arange(0, max(1, heat.shape[1] - height + 1), max(1, stride))
    scores = []
    for top in tops:
        cells = np.sort(heat[:, top : top + height].reshape(len(heat), -1), axis=1)
        hottest = cells[:, -max(1, cells.shape[1] // WINDOW_PART) :].mean(axis=1)
        scores.append(WINDOW_WEIGHTS[0] * np.percentile(cells, WINDOW_PERCENTILE, axis=1) + WINDOW_WEIGHTS[1] * hottest)
    return tops, np.stack(scores, axis=1)


def weighted_fusion(mean: np.ndarray, greatest: np.ndarray, agreement: np.ndarray) -> np.ndarray:
    """Evidence maps as one: mean, greatest and agreement at .58, .27 and .15."""
    return 0.58 * mean + 0.27 * greatest + 0.15 * agreement


def mask_roles(fused: np.ndarray, disagreement: np.ndarray, support: np.ndarray, selected: np.ndarray, hard: np.ndarray, misplaced: float = 0.0) -> dict[str, np.ndarray]:
    """The ten masks a decision gives: who may train, be judged by, be generated in or be kept out of which cells.

    ``support``: share of sources with at least 0.5; ``hard``: whether the
    image's mask may be taken as it is; ``misplaced``: 1 less the share of
    inliers of a registration.
    """
    doubt = np.clip(disagreement + 0.25 * misplaced, 0, 1)
    core, possible = (fused >= 0.80) & (support >= 0.5) & selected, (fused >= 0.35) | selected
    for i in np.flatnonzero(~core.any(axis=(1, 2)) & selected.any(axis=(1, 2))):
        core[i] = selected[i] & (fused[i] >= np.quantile(fused[i][selected[i]], 0.65))
    tight = np.where(hard[:, None, None], selected, core)
    medium = K.dilate(tight, 5)
    return {
        "generation_core": core, "eval_tight": tight, "eval_mvtec": tight, "training_medium": medium, "training_wide": K.dilate(medium, 5),
        "training_soft": np.clip(fused * (1 - 0.75 * doubt) * possible, 0, 1), "positive_core": core, "possible_region": possible, "uncertainty_map": doubt,
        "inpaint_soft": K.gaussian(possible.astype(float), 2.0),
    }


def change_measures(before: np.ndarray, after: np.ndarray, mask: np.ndarray, least: float = 12.0) -> pd.DataFrame:
    """(outside_l1, visibility, leakage) of grey images from 0 to 255; NaN where there is no cell to measure."""
    change = np.abs(before - after)
    mean = lambda v, m: np.divide((v * m).sum((1, 2)), m.sum((1, 2)), out=np.full(len(v), np.nan), where=m.sum((1, 2)) > 0)
    return pd.DataFrame({"outside_l1": mean(change, ~mask) / 255, "visibility": mean(change, mask) / 255, "leakage": mean((change > least) * 1.0, ~mask)})


def placement_measures(box: np.ndarray, refined: np.ndarray, inpaint: np.ndarray, surface: np.ndarray) -> pd.DataFrame:
    """Shares of area and surface of a placed mask; NaN where there is nothing to divide by."""
    area = lambda m: m.sum((1, 2)).astype(float)
    over = lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)
    cells = float(box.shape[1] * box.shape[2])
    b, r, i = area(box), area(refined), area(inpaint)
    return pd.DataFrame({
        "box_area_fraction": b / cells, "refined_area_fraction": r / cells, "refined_to_box_area": over(r, b), "refined_surface_coverage": over(area(refined & surface), r),
        "refined_off_surface_fraction": over(area(refined & ~surface), r), "inpaint_to_refined_area": over(i, r), "inpaint_off_surface_fraction": over(area(inpaint & ~surface), i),
    })


def offset_bins(offsets: np.ndarray, most: int, least: int = 4) -> list[tuple[float, float]]:
    """Ranges around the fullest bins of a histogram that do not hold each other's middle, at most ``most``, in order."""
    if not len(offsets):
        return []
    count, edges = np.histogram(offsets, bins=min(24, max(6, len(offsets) // 8)))
    taken: list[tuple[float, float]] = []
    for peak in np.argsort(-count, kind="stable"):
        span = float(edges[max(0, peak - 1)]), float(edges[min(len(count) - 1, peak + 1) + 1])
        middle = sum(span) / 2
        if count[peak] >= least and len(taken) < most and not any(a <= middle <= b for a, b in taken):
            taken.append(span)
    return sorted(taken)
