"""Scale-invariant keypoints and 128-value descriptors, after D. Lowe, "Distinctive image features from
scale-invariant keypoints" (IJCV 2004), in numpy.

Section 3: extrema of differences of Gaussians over octaves of a scale space. Section 4: their places, by the
Taylor expansion of the difference function, all candidates of an octave at a time; weak and edge-like ones go.
Section 5: orientations from a histogram of gradients. Section 6: a grid of samples that is turned and scaled with
the keypoint, its gradients pooled into 4 x 4 cells of 8 orientations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "tag int, x float, y float, r float, t float, feature array<float>"

# Fixed values, from the paper.
SIGMA = 1.6  # blur of an octave's first level
CAMERA_BLUR = 0.5  # blur that an image is taken to have
SETTLED = 0.5  # an offset up to half a sample belongs to this sample
MOVES = 5
ORIENTATION_BINS = 36
ORIENTATION_WINDOW = 1.5  # times the scale
PEAK_SHARE = 0.8  # of the highest peak
SAMPLES = 16  # along a side of the descriptor's grid
CELLS = 4
DIRECTIONS = 8
CLAMP = 0.2


@dataclass(frozen=True)
class Parameters:
    """``peak`` is the least contrast (of 255), ``cell`` a cell's width in scales."""

    levels: int = 3
    double: bool = False
    peak: float = 3.0
    edge: float = 10.0
    cell: float = 3.0
    smallest: int = 8


def smooth(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, one axis after the other; borders are mirrored."""
    if sigma < 0.05:
        return image
    reach = int(np.ceil(3.5 * sigma))
    x = np.arange(-reach, reach + 1)
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    for axis in (0, 1):
        wide = np.take(image, _mirrored(np.arange(-reach, image.shape[axis] + reach), image.shape[axis]), axis=axis)
        image = np.apply_along_axis(np.convolve, axis, wide, kernel, mode="valid")
    return image


def _mirrored(i: np.ndarray, n: int) -> np.ndarray:
    i = np.mod(i, 2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def scale_space(image: np.ndarray, p: Parameters):
    """(pixels of the image per sample, levels) of each octave; level i has blur ``SIGMA * 2 ** (i / levels)``."""
    step, blur = 1.0, CAMERA_BLUR
    if p.double:
        image, step, blur = _doubled(image), 0.5, 2 * CAMERA_BLUR
    first = smooth(image, np.sqrt(max(0.0, SIGMA**2 - blur**2)))
    blurs = SIGMA * 2.0 ** (np.arange(p.levels + 3) / p.levels)
    while min(first.shape) >= p.smallest:
        levels = [first]
        for add in np.sqrt(np.diff(blurs**2)):
            levels.append(smooth(levels[-1], add))
        yield step, np.stack(levels)
        first, step = levels[p.levels][::2, ::2], 2 * step  # twice the blur at half the resolution


def _doubled(image: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        n = image.shape[axis]
        at = np.arange(2 * n) / 2
        low, high = np.floor(at).astype(int), np.minimum(np.ceil(at).astype(int), n - 1)
        image = (np.take(image, low, axis) + np.take(image, high, axis)) / 2
    return image


def candidates(dog: np.ndarray, least: float) -> np.ndarray:
    """(level, y, x) of samples above or below all 26 neighbours, and not weaker than ``least``."""
    core = dog[1:-1, 1:-1, 1:-1]
    around = np.lib.stride_tricks.sliding_window_view(dog, (3, 3, 3)).reshape(*core.shape, 27)
    others = np.delete(np.arange(27), 13)
    high = (core > around[..., others].max(axis=-1)) & (core >= least)
    low = (core < around[..., others].min(axis=-1)) & (core <= -least)
    return np.argwhere(high | low) + 1


def _expansion(dog: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the difference function at samples, in the order level, y, x."""
    unit = np.eye(3, dtype=int)
    value = lambda shift: dog[tuple((at + shift).T)]
    here = value(0)
    gradient = np.stack([(value(u) - value(-u)) / 2 for u in unit], axis=1)
    hessian = np.empty((len(at), 3, 3))
    for i in range(3):
        for j in range(3):
            if i == j:
                hessian[:, i, i] = value(unit[i]) - 2 * here + value(-unit[i])
            else:
                hessian[:, i, j] = (value(unit[i] + unit[j]) - value(unit[i] - unit[j]) - value(unit[j] - unit[i]) + value(-unit[i] - unit[j])) / 4
    return gradient, hessian


def located(dog: np.ndarray, p: Parameters) -> np.ndarray:
    """(level, y, x) of extrema, interpolated; weak ones and those on edges are left out."""
    at = candidates(dog, p.peak / 2)
    found = []
    for _ in range(MOVES):
        if not len(at):
            break
        gradient, hessian = _expansion(dog, at)
        solid = np.abs(np.linalg.det(hessian)) > 1e-12
        at, gradient, hessian = at[solid], gradient[solid], hessian[solid]
        offset = -np.linalg.solve(hessian, gradient[..., None])[..., 0]
        settled = (np.abs(offset) <= SETTLED).all(axis=1)
        contrast = dog[tuple(at.T)] + (gradient * offset).sum(axis=1) / 2
        trace, det = hessian[:, 1, 1] + hessian[:, 2, 2], hessian[:, 1, 1] * hessian[:, 2, 2] - hessian[:, 1, 2] ** 2
        blob = (det > 0) & (trace**2 * p.edge < (p.edge + 1) ** 2 * det)
        keep = settled & blob & (np.abs(contrast) >= p.peak)
        found.append(at[keep] + offset[keep])
        # the others try the sample that their extremum is nearer to
        at = at[~settled] + np.clip(np.rint(offset[~settled]), -1, 1).astype(int)
        at = at[((at >= 1) & (at < np.array(dog.shape) - 1)).all(axis=1)]
    every = np.concatenate(found) if found else np.empty((0, 3))
    return every[np.unique(np.round(every, 6), axis=0, return_index=True)[1]] if len(every) else every


def _gradient_at(gx: np.ndarray, gy: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both components, interpolated between samples; zero outside the image."""
    h, w = gx.shape
    inside = (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
    x0, y0 = np.clip(np.floor(x), 0, max(0, w - 2)).astype(int), np.clip(np.floor(y), 0, max(0, h - 2)).astype(int)
    fx, fy = x - x0, y - y0
    out = []
    for g in (gx, gy):
        upper = g[y0, x0] * (1 - fx) + g[y0, x0 + 1] * fx
        lower = g[y0 + 1, x0] * (1 - fx) + g[y0 + 1, x0 + 1] * fx
        out.append(np.where(inside, upper * (1 - fy) + lower * fy, 0.0))
    return out[0], out[1]


def orientations(gx: np.ndarray, gy: np.ndarray, x: np.ndarray, y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keypoint, angle): the highest peak of each keypoint's histogram, and others that come near it."""
    reach = np.linspace(-3, 3, 25)  # in standard deviations of the window
    v, u = (a.ravel() for a in np.meshgrid(reach, reach, indexing="ij"))
    spread = ORIENTATION_WINDOW * scale[:, None]
    ex, ey = _gradient_at(gx, gy, x[:, None] + u * spread, y[:, None] + v * spread)
    weight = np.hypot(ex, ey) * np.exp(-(u**2 + v**2) / 2)
    place = np.arctan2(ey, ex) / (2 * np.pi) * ORIENTATION_BINS
    low = np.floor(place)
    bins = np.zeros((len(x), ORIENTATION_BINS))
    rows = np.broadcast_to(np.arange(len(x))[:, None], place.shape)
    for side, share in ((0, 1 - (place - low)), (1, place - low)):
        np.add.at(bins, (rows, (low.astype(int) + side) % ORIENTATION_BINS), weight * share)
    before, after = np.roll(bins, 1, axis=1), np.roll(bins, -1, axis=1)
    k, b = np.nonzero((bins > before) & (bins > after) & (bins >= PEAK_SHARE * bins.max(axis=1, keepdims=True)))
    # a parabola through the peak and its two neighbours
    left, top, right = before[k, b], bins[k, b], after[k, b]
    peak = b + (left - right) / (2 * (left - 2 * top + right))
    return k, np.mod(peak * 2 * np.pi / ORIENTATION_BINS, 2 * np.pi)


def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the samples in cell widths from the centre, and each sample's weight in each cell."""
    line = (np.arange(SAMPLES) + 0.5) * CELLS / SAMPLES - CELLS / 2
    v, u = (a.ravel() for a in np.meshgrid(line, line, indexing="ij"))
    centre = np.arange(CELLS) + 0.5 - CELLS / 2
    near = lambda a: np.maximum(0, 1 - np.abs(a[:, None] - centre[None]))
    window = np.exp(-(u**2 + v**2) / (2 * (CELLS / 2) ** 2))
    cells = (near(v)[:, :, None] * near(u)[:, None, :]).reshape(len(u), -1) * window[:, None]
    return u, v, cells


_U, _V, _WEIGHTS = _grid()


def descriptors(gx: np.ndarray, gy: np.ndarray, x: np.ndarray, y: np.ndarray, scale: np.ndarray, turn: np.ndarray, cell: float) -> np.ndarray:
    """One row of 128 values per keypoint, of length 1."""
    c, s, width = np.cos(turn)[:, None], np.sin(turn)[:, None], cell * scale[:, None]
    ex, ey = _gradient_at(gx, gy, x[:, None] + (c * _U - s * _V) * width, y[:, None] + (s * _U + c * _V) * width)
    direction = np.mod((np.arctan2(ey, ex) - turn[:, None]) / (2 * np.pi) * DIRECTIONS, DIRECTIONS)
    away = np.abs(direction[..., None] - np.arange(DIRECTIONS))
    share = np.maximum(0, 1 - np.minimum(away, DIRECTIONS - away)) * np.hypot(ex, ey)[..., None]
    out = np.einsum("ksd,sc->kcd", share, _WEIGHTS).reshape(len(x), -1)
    for top in (CLAMP, np.inf):  # large gradients count for less
        length = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.minimum(out / np.where(length > 0, length, 1), top)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def keypoints(image: np.ndarray, p: Parameters = Parameters()) -> list[tuple[float, float, float, float, np.ndarray]]:
    """(x, y, scale, turn, descriptor) of a gray image with values 0 to 255."""
    out = []
    for step, levels in scale_space(image.astype(float), p):
        found = located(np.diff(levels, axis=0), p)
        nearest = np.rint(found[:, 0]).astype(int)
        for level in np.unique(nearest):  # all keypoints of a level together
            z, y, x = found[nearest == level].T
            scale = SIGMA * 2.0 ** (z / p.levels)
            gy, gx = np.gradient(levels[level])
            k, turn = orientations(gx, gy, x, y, scale)
            values = descriptors(gx, gy, x[k], y[k], scale[k], turn, p.cell)
            out += list(zip((x[k] * step).tolist(), (y[k] * step).tolist(), (scale[k] * step).tolist(), turn.tolist(), values))
    return out


def extract_keypoints(images: DataFrame, key: str = "object", p: Parameters = Parameters()) -> DataFrame:
    """One row per keypoint of images (key, width, height, pixels row by row); an empty or broken image has none."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for name, w, h, pixels in zip(pdf[key], pdf["width"], pdf["height"], pdf["pixels"]):
                if pixels is None or w * h == 0 or len(pixels) != w * h or min(w, h) < p.smallest:
                    continue
                for tag, (x, y, r, t, d) in enumerate(keypoints(np.asarray(pixels, float).reshape(h, w), p)):
                    # stored as descriptors are: doubled, at most 1; the turn as a share of a whole one
                    rows.append((name, tag, x, y, r, t / (2 * np.pi), np.minimum(2 * d, 1).tolist()))
            yield pd.DataFrame(rows, columns=[key, "tag", "x", "y", "r", "t", "feature"])

    return images.select(key, "width", "height", "pixels").mapInPandas(run, f"{key} {kind}, {SCHEMA}")
