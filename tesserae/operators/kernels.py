"""Raster kernels on stacks of images, (n, height, width), in NumPy.

Every kernel takes a whole Arrow batch at once. Images never leave their row,
so raster operators need no shuffle at any size.
"""

from __future__ import annotations

import numpy as np


def windows(x: np.ndarray, radius: int, fill: float, mode: str = "constant") -> np.ndarray:
    """(n, h, w, k): the square neighbourhood of every cell."""
    extra = {"constant_values": fill} if mode == "constant" else {}
    p = np.pad(x, ((0, 0), (radius, radius), (radius, radius)), mode=mode, **extra)
    side = 2 * radius + 1
    v = np.lib.stride_tricks.sliding_window_view(p, (side, side), axis=(1, 2))
    return v.reshape(*x.shape, side * side)


def dilate(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return windows(mask.astype(np.int8), size // 2, 0).max(axis=-1) > 0


def erode(mask: np.ndarray, size: int = 3) -> np.ndarray:
    """Cells outside the image do not count against a cell."""
    return windows(mask.astype(np.int8), size // 2, 1).min(axis=-1) > 0


def close(mask: np.ndarray, size: int = 5) -> np.ndarray:
    return erode(dilate(mask, size), size)


def components(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Least position of each cell's component, -1 outside the mask.

    Labels run along rows and columns by running minima until nothing changes.
    """
    n, h, w = mask.shape
    big = h * w
    label = np.where(mask, np.arange(big).reshape(1, h, w), big)
    while True:
        p = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=big)
        near = [p[:, :-2, 1:-1], p[:, 2:, 1:-1], p[:, 1:-1, :-2], p[:, 1:-1, 2:]]
        if eight:
            near += [p[:, :-2, :-2], p[:, :-2, 2:], p[:, 2:, :-2], p[:, 2:, 2:]]
        new = np.where(mask, np.minimum(label, np.minimum.reduce(near)), big)
        flat = np.concatenate([new.reshape(n, big), np.full((n, 1), big)], axis=1)
        new = np.where(mask, np.take_along_axis(flat, new.reshape(n, big), axis=1).reshape(n, h, w), big)
        if (new == label).all():
            return np.where(mask, label, -1)
        label = new


def box_blur(x: np.ndarray, radius: int = 1) -> np.ndarray:
    return windows(x, radius, 0, "reflect").mean(axis=-1)


def gradients(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences along y and x: central inside, one-sided at the border."""
    return np.gradient(x, axis=1), np.gradient(x, axis=2)


def normalised(x: np.ndarray) -> np.ndarray:
    """Each image between 0 and 1; a constant one is 0."""
    lo, hi = x.min(axis=(1, 2), keepdims=True), x.max(axis=(1, 2), keepdims=True)
    return np.where(hi > lo, (x - lo) / np.where(hi > lo, hi - lo, 1), 0.0)


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, reflected at the border, cut at four sigma."""
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p = np.pad(x, pad, mode="symmetric")
        x = (np.lib.stride_tricks.sliding_window_view(p, 2 * r + 1, axis=axis) * k).sum(axis=-1)
    return x


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear: shrinking averages over the cells a new one covers, growing goes straight between centres."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = max(1.0, n / m)
        centre = (np.arange(m) + 0.5) * n / m - 0.5
        w = np.maximum(0.0, 1 - np.abs(np.arange(n)[None, :] - centre[:, None]) / scale)
        return w / w.sum(axis=1, keepdims=True)

    return np.einsum("ai,nij,bj->nab", weights(x.shape[1], height), x, weights(x.shape[2], width))


def structure_ridge(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Where brightness changes along one direction only, weighted by how much."""
    smooth = gaussian(x, sigma)
    gy, gx = gradients(smooth)
    jxx, jyy, jxy = gaussian(gx * gx, sigma), gaussian(gy * gy, sigma), gaussian(gx * gy, sigma)
    coherence = np.sqrt((jxx - jyy) ** 2 + 4 * jxy**2) / (jxx + jyy + 1e-6)
    return normalised(coherence * (0.58 * normalised(np.hypot(gx, gy)) + 0.42 * normalised(np.abs(x - smooth))))


def fft_notch(x: np.ndarray, peaks: int = 4, low: float = 0.15) -> np.ndarray:
    """Regular texture taken out: the strongest frequencies outside a low disc go, with their mirrors."""
    n, h, w = x.shape
    hann = np.hanning(h)[:, None] * np.hanning(w)[None, :]
    spectrum = np.fft.fft2((x - x.mean(axis=(1, 2), keepdims=True)) * hann)
    fy, fx = np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)[None, :]
    strength = np.where(np.hypot(fy, fx) > low, np.abs(spectrum), 0).reshape(n, -1)
    top = np.argsort(-strength, axis=1, kind="stable")[:, :peaks]
    mirror = ((-(top // w)) % h) * w + (-(top % w)) % w
    keep = np.ones((n, h * w))
    np.put_along_axis(keep, top, 0, axis=1)
    np.put_along_axis(keep, mirror, 0, axis=1)
    return normalised(np.abs(np.fft.ifft2(spectrum * keep.reshape(n, h, w)).real))


def patch_features(x: np.ndarray, size: int = 4, stride: int = 2) -> np.ndarray:
    """(n, patches, 7): mean, deviation, least, greatest, mean slopes and mean change per patch."""
    gy, gx = gradients(x)
    cut = lambda a: np.lib.stride_tricks.sliding_window_view(a, (size, size), axis=(1, 2))[:, ::stride, ::stride].reshape(len(a), -1, size * size)
    p, py, px = cut(x), cut(gy), cut(gx)
    return np.stack([p.mean(-1), p.std(-1), p.min(-1), p.max(-1), py.mean(-1), px.mean(-1), np.hypot(py, px).mean(-1)], axis=-1)


def periodicity(mask: np.ndarray) -> float:
    """Share of the strongest frequency in the mask's projection on its longer side; 0 below eight places or without change."""
    line = mask.mean(axis=1 if mask.shape[0] >= mask.shape[1] else 0)
    if line.size < 8 or line.std() < 1e-6:
        return 0.0
    spectrum = np.abs(np.fft.rfft(line - line.mean()))
    return float(np.clip(spectrum[1:].max() / max(1e-6, spectrum[1:].sum()), 0.0, 1.0)) if spectrum.size > 2 else 0.0


def mask_measurements(mask: np.ndarray, score: np.ndarray, count: int) -> dict[str, float]:
    """The measurements of a proposal of ``count`` components that need only its mask and the fused score."""
    ys, xs = np.nonzero(mask)
    h, w = int(np.ptp(ys)) + 1, int(np.ptp(xs)) + 1
    area, inside = len(ys), float(score[mask].mean())
    return {
        "evidence_coverage": inside, "normal_contrast": inside - (float(score[~mask].mean()) if area < mask.size else 0.0),
        "component_count": float(count), "area_fraction": area / mask.size, "compactness": area / (h * w), "elongation": max(w / h, h / w),
        "boundary_contact": float(np.mean([mask[0].any(), mask[-1].any(), mask[:, 0].any(), mask[:, -1].any()])), "periodicity_disruption": periodicity(mask),
    }


def generic_proposals(score: np.ndarray, quantiles: tuple[float, ...] = (0.85, 0.90, 0.95, 0.975), min_area: int = 8, least: float = 0.05) -> list[tuple[str, np.ndarray, dict[str, float]]]:
    """(mode, mask, measurements) of one image: per quantile the whole mask and its four largest components, each mask once.

    Components below ``min_area`` are removed; no threshold is below ``least``.
    """
    out, seen = [], set()
    finite = score[np.isfinite(score)]
    for q in quantiles:
        raw = score >= max(least, float(np.quantile(finite, q)) if finite.size else 1.0)
        label = components(raw[None], True)[0]
        names, sizes = np.unique(label[label >= 0], return_counts=True)
        names, sizes = names[sizes >= min_area], sizes[sizes >= min_area]
        mode = f"fused_q{round(q * 1000):03d}"
        parts = [(f"{mode}_component_{i + 1}", label == names[k], 1) for i, k in enumerate(np.argsort(-sizes, kind="stable")[:4])]
        for name, mask, count in [(mode, np.isin(label, names), len(names)), *parts]:
            key = np.packbits(mask).tobytes()
            if mask.any() and key not in seen:
                seen.add(key)
                out.append((name, mask, mask_measurements(mask, score, count)))
    return out


def aupro(score: np.ndarray, truth: np.ndarray, limit: float = 0.3) -> np.ndarray:
    """Mean overlap per true component against false positives up to ``limit``, over 101 thresholds; NaN without either class.

    Thresholds fall from 1 to 0, points beyond the limit are left out, (0, 0)
    and (limit, last overlap) are added, the trapezoid is divided by the limit.
    """
    label = components(truth)
    out = np.full(len(score), np.nan)
    steps = np.linspace(1, 0, 101)
    for i in range(len(score)):
        names, inverse = np.unique(label[i][truth[i]], return_inverse=True)
        outside = score[i][~truth[i]]
        if not len(names) or not len(outside):
            continue
        inside = score[i][truth[i]]
        size = np.bincount(inverse)
        overlap = np.array([(np.bincount(inverse, inside >= t) / size).mean() for t in steps])
        false = np.array([(outside >= t).mean() for t in steps])
        kept = false <= limit
        x, y = np.r_[0.0, false[kept], limit], np.r_[0.0, overlap[kept], overlap[kept][-1] if kept.any() else 0.0]
        order = np.argsort(x, kind="stable")
        out[i] = np.trapezoid(y[order], x[order]) / limit
    return out


def greedy_windows(score: np.ndarray, place: np.ndarray, gap: float, most: int) -> np.ndarray:
    """Indices of the best windows whose centres keep a distance, by place."""
    chosen: list[int] = []
    for i in np.lexsort((place, -score)):
        if len(chosen) >= most:
            break
        if all(abs(place[i] - place[j]) >= gap for j in chosen):
            chosen.append(int(i))
    return np.array(sorted(chosen, key=lambda i: place[i]), np.int64)
