"""Visual features of page images (M13): size, brightness, contrast, edges, text blocks, layout, sharpness, histogram.

An image is one row and is decoded and measured in numpy, a batch of images a task. Decoding is a parameter; the
default reads PNG files of 8 bits a channel that are not interlaced. Images that cannot be read have null features.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png(data: bytes) -> np.ndarray:
    """Grey values (rows x columns) of a PNG file: colours are weighed .299, .587, .114, transparency is ignored."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, palette = 8, [], b""
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced or colour not in CHANNELS:
                raise ValueError("only 8 bits a channel without interlacing")
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    c = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * c)
    out, above = np.empty((height, width, c), np.uint8), np.zeros((width, c), np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:].reshape(width, c), above)
    if colour == 3:
        out = np.frombuffer(palette, np.uint8).reshape(-1, 3)[out[..., 0]]
    if out.shape[2] < 3:
        return out[..., 0]
    return np.floor(out[..., :3] @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, axis=0, dtype=np.uint64).astype(np.uint8)
    if kind == 2:
        return row + above
    out, left, corner = np.empty_like(row), np.zeros(row.shape[1], np.int64), np.zeros(row.shape[1], np.int64)
    up = above.astype(np.int64)
    for x in range(len(row)):
        if kind == 3:
            guess = (left + up[x]) // 2
        else:
            p = left + up[x] - corner
            a, b, d = np.abs(p - left), np.abs(p - up[x]), np.abs(p - corner)
            guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, up[x], corner))
        left = (row[x] + guess) & 255
        out[x], corner = left, up[x]
    return out


def _convolved(x: np.ndarray, column: list[float], row: list[float]) -> np.ndarray:
    """A separable filter with mirrored borders (the border itself is not repeated)."""
    k = len(column) // 2
    p = np.pad(x.astype(np.float64), k, mode="reflect") if min(x.shape) > k else np.pad(x.astype(np.float64), k, mode="edge")
    tall = sum(w * p[i : i + x.shape[0]] for i, w in enumerate(column))
    return sum(w * tall[:, i : i + x.shape[1]] for i, w in enumerate(row))


def components(mask: np.ndarray) -> np.ndarray:
    """Sizes of the connected parts of a mask, neighbours at corners included: runs of rows are joined by their overlaps."""
    roots, sizes, before = [], [], []

    def find(i: int) -> int:
        while roots[i] != i:
            roots[i] = roots[roots[i]]
            i = roots[i]
        return i

    for line in mask:
        edges = np.flatnonzero(np.diff(line.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
        now, j = [], 0
        for a, b in edges:
            me = len(roots)
            roots.append(me)
            sizes.append(b - a)
            while j < len(before) and before[j][1] < a:
                j += 1
            i = j
            while i < len(before) and before[i][0] <= b:
                roots[find(before[i][2])] = find(me)
                i += 1
            now.append((a, b, me))
        before = now
    total: dict[int, int] = {}
    for i, n in enumerate(sizes):
        r = find(i)
        total[r] = total.get(r, 0) + n
    return np.array(sorted(total.values()), np.int64)


def canny(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: ridges of the gradient |dx| + |dy| over low that touch one over high."""
    gx, gy = _convolved(x, [1, 2, 1], [-1, 0, 1]), _convolved(x, [-1, 0, 1], [1, 2, 1])
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    shifted = lambda dy, dx: p[1 + dy : 1 + dy + x.shape[0], 1 + dx : 1 + dx + x.shape[1]]
    flat, steep = np.abs(gy) < 0.41421356 * np.abs(gx), np.abs(gy) > 2.41421356 * np.abs(gx)
    same = (gx < 0) == (gy < 0)
    before = np.select([flat, steep, same], [shifted(0, -1), shifted(-1, 0), shifted(-1, -1)], shifted(-1, 1))
    after = np.select([flat, steep, same], [shifted(0, 1), shifted(1, 0), shifted(1, 1)], shifted(1, -1))
    weak = (size > before) & (size >= after) & (size > low)
    strong = weak & (size > high)
    while True:
        near = np.pad(strong, 1)
        grown = weak & np.logical_or.reduce([near[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)])
        if (grown == strong).all():
            return strong
        strong = grown


def otsu(histogram: np.ndarray) -> int:
    """The grey value that parts a histogram with the greatest variance between both sides."""
    n, level = histogram.sum(), np.arange(256)
    below = np.cumsum(histogram)
    first = np.cumsum(histogram * level)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (first[-1] * below / n - first) ** 2 / (below * (n - below))
    return int(np.nan_to_num(spread, nan=-1, posinf=-1).argmax())


def peaks(x: np.ndarray, height: float, distance: int) -> int:
    """How many local maxima of at least height there are, the higher of two that are closer than distance."""
    edge = np.flatnonzero(np.diff(x, prepend=x[:1] - 1) != 0)
    start, stop = edge, np.append(edge[1:], len(x))
    top = [(int(a), int(b)) for a, b in zip(start, stop, strict=True) if a > 0 and b < len(x) and x[a] > x[a - 1] and x[b] < x[a] and x[a] >= height]
    places = [(a + b - 1) // 2 for a, b in top]
    kept: list[int] = []
    for p in sorted(places, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return len(kept)


def features(x: np.ndarray) -> dict[str, float]:
    """The 28 features of a grey image."""
    height, width = x.shape
    n, level = x.size, np.arange(256)
    histogram = np.bincount(x.reshape(-1), minlength=256)
    mean = float(histogram @ level / n)
    deviation = float(np.sqrt(histogram @ (level - mean) ** 2 / n))
    third = float(histogram @ (level - mean) ** 3 / n)
    low, high, median = int(x.min()), int(x.max()), float(np.median(x))
    edges = canny(x, int(max(0, 0.67 * median)), int(min(255, 1.33 * median)))
    gradient = np.sqrt(_convolved(x, [1, 2, 1], [-1, 0, 1]) ** 2 + _convolved(x, [-1, 0, 1], [1, 2, 1]) ** 2)
    strength = float(gradient.mean())
    laplacian = _convolved(x, [0, 1, 0], [1, -2, 1]) + _convolved(x, [1, -2, 1], [0, 1, 0])
    blurred = np.floor(_convolved(x, [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16], [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16]) + 0.5)
    ink = np.pad(x <= otsu(histogram), 4)  # two dilations by 5 x 5 are one by 9 x 9
    tall = np.logical_or.reduce([ink[i : i + height] for i in range(9)])
    blocks = components(np.logical_or.reduce([tall[:, j : j + width] for j in range(9)]))
    blocks = blocks[blocks >= 100]
    profile = edges.sum(0) * 255
    p = histogram[histogram > 0] / n
    return {
        "height": height, "width": width, "aspect_ratio": round(height / width, 3), "total_pixels": n, "megapixels": round(n / 1e6, 2),
        "brightness_mean": round(mean, 2), "brightness_std": round(deviation, 2), "brightness_median": round(median, 2), "brightness_min": low, "brightness_max": high,
        "dynamic_range": high - low, "contrast_ratio": round((high - low) / (high + low), 3) if high + low else 0.0, "rms_contrast": round(deviation, 2),
        "edge_density": round(float(edges.mean()), 5), "edge_count": int(edges.sum()), "avg_edge_strength": round(strength, 2),
        "text_block_count": len(blocks), "avg_block_size": round(float(blocks.mean()), 2) if len(blocks) else 0.0, "block_area_ratio": round(float(blocks.sum()) / n, 4),
        "estimated_columns": peaks(profile, 0.3 * float(profile.max()), max(1, width // 10)) + 1,
        "blur_estimate": round(float(laplacian.var()), 2), "noise_estimate": round(float(np.abs(x - blurred).mean()), 2), "sharpness": round(strength, 2),
        "histogram_entropy": round(float(-(p * np.log2(p)).sum()), 3), "brightness_skewness": round(third / deviation**3, 3) if deviation else 0.0, "dominant_brightness_bin": int(histogram.argmax()),
        "brightness_p25": round(float(np.percentile(x, 25)), 2), "brightness_p75": round(float(np.percentile(x, 75)), 2),
    }


NAMES = list(features(np.zeros((2, 2), np.uint8)))


def visual_features(images: DataFrame, page: str = "page", content: str = "content", decode: Callable[[bytes], np.ndarray] = png) -> DataFrame:
    """(page, one column a feature) of image files; nulls where a file cannot be read."""
    ship(images.sparkSession)
    rows = images.select(page, content)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for data in part[content]:
                try:
                    found.append(features(decode(bytes(data))))
                except Exception:  # noqa: BLE001  a broken file may fail in any way
                    found.append(dict.fromkeys(NAMES))
            out = pd.DataFrame(found, columns=NAMES, index=part.index).astype("float64")
            out.insert(0, page, part[page])
            yield out

    return rows.mapInPandas(run, ", ".join([f"`{page}` {rows.schema[page].dataType.simpleString()}", *(f"{n} double" for n in NAMES)]))
