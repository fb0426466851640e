"""Order-dependent operators, one group (a frame, a layer, a palette of distinct colours) at a time in grouped pandas functions.

Groups are bounded by what they are: a frame has side² pixels, a palette's distinct colours are counted before they are gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gif, lzw
from ..functions.color import pack, unpack


# ---- palettes from weighted colours
def median_cut(colours: list[tuple[int, int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """(r, g, b, n) -> means of k boxes, as trees.median_cut() has them, for a list that is at hand."""
    boxes = [sorted(colours)] if colours else []
    while len(boxes) < k:
        widths = [max((max(c[i] for c in b) - min(c[i] for c in b), -i) for i in range(3)) for b in boxes]
        best = max(range(len(boxes)), key=lambda i: (widths[i][0], -i), default=None)
        if best is None or widths[best][0] == 0:
            break
        axis = -widths[best][1]
        box = sorted(boxes[best], key=lambda c: (c[axis], c))
        half, run, cut = sum(c[3] for c in box) / 2, 0, len(box) - 1
        for i, c in enumerate(box[:-1]):
            run += c[3]
            if run >= half:
                cut = i + 1
                break
        boxes[best : best + 1] = [box[:cut], box[cut:]]
    total = [sum(c[3] for c in b) for b in boxes]
    return [tuple(sum(c[i] * c[3] for c in b) // n for i in range(3)) for b, n in zip(boxes, total, strict=True)]


def octree(colours: list[tuple[int, int, int, int]], k: int, lowest_bit_first: bool = False) -> list[tuple[int, int, int]]:
    """(r, g, b, n) -> up to k colours, as trees.octree() has them, for a list that is at hand."""

    def path(c: tuple) -> tuple[int, ...]:
        bits = range(8) if lowest_bit_first else range(7, -1, -1)
        return tuple((c[0] >> i & 1) << 2 | (c[1] >> i & 1) << 1 | c[2] >> i & 1 for i in bits)

    leaves: dict[tuple, list[int]] = {}
    for c in sorted(colours):
        s = leaves.setdefault(path(c), [0, 0, 0, 0])
        for i in range(3):
            s[i] += c[i] * c[3]
        s[3] += c[3]
    while len(leaves) > k:
        depth = max(map(len, leaves))
        parents: dict[tuple, list[int]] = {}
        for p in leaves:
            if len(p) == depth:
                s = parents.setdefault(p[:-1], [0, 0, 0, 0])
                for i in range(4):
                    s[i] += leaves[p][i]
        for parent, s in sorted(parents.items(), key=lambda x: (299 * x[1][0] + 587 * x[1][1] + 114 * x[1][2], x[0])):
            for child in range(8):
                leaves.pop((*parent, child), None)
            leaves[parent] = s
            if len(leaves) <= k:
                break
    out = sorted(leaves.values(), key=lambda s: (-s[3], s[:3]))
    return [tuple(s[i] // s[3] for i in range(3)) for s in out]


# ---- rasters
def dither(pixels: np.ndarray, palette: np.ndarray, spread: np.ndarray | None = None) -> np.ndarray:
    """Floyd-Steinberg in raster order (7, 3, 5, 1 of 16); where spread is False a pixel's error goes nowhere."""
    h, w, _ = pixels.shape
    work, out = pixels.astype(float).copy(), np.zeros((h, w), np.int32)
    for y in range(h):
        for x in range(w):
            c = np.clip(work[y, x], 0, 255)
            i = int(((palette - c) ** 2).sum(1).argmin())
            out[y, x] = i
            if spread is not None and not spread[y, x]:
                continue
            e = c - palette[i]
            if x + 1 < w:
                work[y, x + 1] += e * (7 / 16)
            if y + 1 < h:
                if x:
                    work[y + 1, x - 1] += e * (3 / 16)
                work[y + 1, x] += e * (5 / 16)
                if x + 1 < w:
                    work[y + 1, x + 1] += e * (1 / 16)
    return out


def dithered(cube: DataFrame, palette: list[tuple[int, int, int]], side: int = 81, adaptive: str | None = None) -> DataFrame:
    """f, y, x, idx; adaptive: a column of weights, below 0.3 of which alone errors spread. palette: 256 colours at most."""
    table = np.array(palette, float)

    def one(d: pd.DataFrame) -> pd.DataFrame:
        image, soft = np.zeros((side, side, 3)), np.ones((side, side), bool)
        image[d.y, d.x] = d[["r", "g", "b"]].to_numpy()
        if adaptive:
            soft[d.y, d.x] = d[adaptive] < 0.3
        return pd.DataFrame({"f": d.f, "y": d.y, "x": d.x, "idx": dither(image, table, soft)[d.y, d.x]})

    return cube.groupBy("f").applyInPandas(one, "f int, y int, x int, idx int")


def rasters(indexed: DataFrame) -> DataFrame:
    """f, indices (binary in raster order): each frame's pixels."""
    items = F.sort_array(F.collect_list(F.struct("y", "x", "idx")))
    return indexed.groupBy("f").agg(F.unhex(F.array_join(F.transform(items, lambda e: F.lpad(F.hex(e["idx"].cast("long")), 2, "0")), "")).alias("indices"))


def _bytes_udf(f, kind: str = "binary"):
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else f(bytes(b)))

    return F.pandas_udf(each, kind)


def lzw_encoded(data: Column) -> Column:
    return _bytes_udf(lzw.encode)(data)


def lzw_decoded(data: Column) -> Column:
    return _bytes_udf(lzw.decode)(data)


REPORT = "valid boolean, reason string, width int, height int, frames int, global_colours int, local_tables int, loops int, trailer boolean, bytes long"


def gif_report(data: Column) -> Column:
    def each(s: pd.Series) -> pd.DataFrame:
        whole = ("width", "height", "frames", "global_colours", "local_tables", "loops", "bytes")
        return pd.DataFrame([gif.report(bytes(b or b"")) for b in s]).astype({c: "Int64" for c in whole})

    return F.pandas_udf(each, REPORT)(data)


def gifs(rasters_: DataFrame, by: list[str], palette: list[tuple[int, int, int]], width: int, height: int, delay: int = 4) -> DataFrame:
    """by..., gif: the frames (f, indices) of each group in order, in one file; the format is a sequence, so a group is one task's."""

    def one(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("f")
        g = gif.Gif(width, height, palette, [gif.Frame(bytes(b), delay) for b in d.indices])
        return pd.DataFrame([(*key, gif.write(g))], columns=[*by, "gif"])

    kinds = dict(rasters_.dtypes)
    return rasters_.groupBy(*by).applyInPandas(one, ", ".join([*(f"{c} {kinds[c]}" for c in by), "gif binary"]))


def argb_list(palette: DataFrame) -> list[tuple[int, int, int]]:
    """A palette of at most 256 colours (more is an error), in order, on the driver."""
    found = [(r.r, r.g, r.b) for r in palette.orderBy("idx").limit(257).select("r", "g", "b").collect()]
    if len(found) > 256:
        raise ValueError("a palette of more than 256 colours")
    return found


def distinct_argb(df: DataFrame) -> DataFrame:
    r, g, b = unpack(F.col("argb"))
    return df.select(pack(F.col("r"), F.col("g"), F.col("b"), None).alias("argb")).distinct().withColumns({"r": r, "g": g, "b": b})
