"""Visual features against brute force on small images."""

import math
import struct
import zlib

import numpy as np
import pytest

from tallystone.operators import images as I


def write_png(x, kind=0):
    """A PNG file of grey or colour values whose rows all use one filter."""
    x = x if x.ndim == 3 else x[..., None]
    h, w, c = x.shape
    lines, above = [], np.zeros((w, c), np.int64)
    for row in x.astype(np.int64):
        left, corner = np.vstack([np.zeros((1, c), np.int64), row[:-1]]), np.vstack([np.zeros((1, c), np.int64), above[:-1]])
        p = left + above - corner
        a, b, d = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0, left, above, (left + above) // 2, np.where((a <= b) & (a <= d), left, np.where(b <= d, above, corner))][kind]
        lines.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    grey = rng.integers(0, 256, (7, 9)).astype(np.uint8)
    assert (I.png(write_png(grey, kind)) == grey).all()
    colour = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    want = [[int(0.299 * r + 0.587 * g + 0.114 * b + 0.5) for r, g, b in line] for line in colour.tolist()]
    assert np.abs(I.png(write_png(colour, kind)).astype(int) - want).max() <= 1
    with pytest.raises(ValueError):
        I.png(b"GIF89a")


def brute_components(mask):
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        todo, n = [left.pop()], 1
        while todo:
            y, x = todo.pop()
            for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
                    n += 1
        out.append(n)
    return sorted(out)


def test_components_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.4, 0.6):
        mask = rng.random((25, 30)) < share
        assert I.components(mask).tolist() == brute_components(mask)
    assert I.components(np.zeros((3, 3), bool)).tolist() == []


def test_filters_against_brute_force():
    x = np.random.default_rng(4).integers(0, 256, (6, 8)).astype(np.uint8)
    at = lambda y, k: float(x[abs(y) if y < 6 else 10 - y, abs(k) if k < 8 else 14 - k])
    kernel = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
    want = [[sum(kernel[i][j] * at(y + i - 1, k + j - 1) for i in range(3) for j in range(3)) for k in range(8)] for y in range(6)]
    assert np.allclose(I._convolved(x, [1, 2, 1], [-1, 0, 1]), want)


def test_otsu_is_the_best_cut():
    h = np.zeros(256, np.int64)
    h[[10, 12, 200, 210]] = [40, 30, 20, 10]
    values = np.repeat(np.arange(256), h)

    def within(t):
        a, b = values[values <= t], values[values > t]
        return (a.var() * len(a) if len(a) else 0) + (b.var() * len(b) if len(b) else 0)

    assert within(I.otsu(h)) == pytest.approx(min(within(t) for t in range(256)))


def test_features_of_a_page():
    x = np.full((120, 200), 255, np.uint8)
    x[20:40, 20:80] = 0
    x[60:80, 20:80] = 0
    x[20:40, 120:180] = 0
    f = I.features(x)
    assert (f["height"], f["width"], f["total_pixels"], f["dynamic_range"], f["contrast_ratio"], f["text_block_count"]) == (120, 200, 24000, 255, 1.0, 3)
    assert f["avg_block_size"] == (20 + 8) * (60 + 8) and f["brightness_mean"] == round(255 * (1 - 3600 / 24000), 2) and f["dominant_brightness_bin"] == 255
    p = 3600 / 24000
    assert f["histogram_entropy"] == round(-p * math.log2(p) - (1 - p) * math.log2(1 - p), 3) and f["edge_count"] > 300
    assert I.peaks(np.array([0, 3, 0, 2, 2, 0, 5, 0.0]), 2, 1) == 3 and I.peaks(np.array([0, 3, 0, 2, 2, 0, 5, 0.0]), 2, 6) == 1
    assert len(f) == 28 and I.features(np.zeros((1, 1), np.uint8))["edge_count"] == 0


def test_broken_files_have_no_features(spark, tmp_path):
    from tallystone.sources.pages import images

    (tmp_path / "1700_1_image.png").write_bytes(write_png(np.random.default_rng(1).integers(0, 256, (30, 40)).astype(np.uint8), 4))
    (tmp_path / "1701_1_image.png").write_bytes(b"broken")
    got = {r["page"]: r["width"] for r in I.visual_features(images(spark, str(tmp_path))).collect()}
    assert got == {"1700_1_image": 40.0, "1701_1_image": None}
