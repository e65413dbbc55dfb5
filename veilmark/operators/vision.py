"""Detector arithmetic: the prior grid, box decoding, output parsing, pixel bands and pixel redaction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The grid of a 320 x 240 detector and its variances.
WIDTH, HEIGHT = 320, 240
STRIDES = (8, 16, 32, 64)
BOXES = ((10, 16, 24), (32, 48), (64, 96), (128, 192, 256))
VARIANCES = (0.1, 0.2)
SCORE, OVERLAP = 0.7, 0.3


def priors(spark: SparkSession) -> DataFrame:
    """(ord, cx, cy, w, h) of all priors, normalised; level, row, column, box order."""
    parts = None
    for level, (stride, boxes) in enumerate(zip(STRIDES, BOXES, strict=True)):
        rows, cols = -(-HEIGHT // stride), -(-WIDTH // stride)
        grid = spark.range(rows * cols).select(F.lit(level).alias("level"), F.floor(F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
        grid = grid.select("*", F.posexplode(F.array(*[F.lit(float(b)) for b in boxes])).alias("k", "box"))
        grid = grid.select(
            "level", "i", "j", "k", F.least(F.greatest((F.col("j") + 0.5) * stride / WIDTH, F.lit(0.0)), F.lit(1.0)).alias("cx"), F.least(F.greatest((F.col("i") + 0.5) * stride / HEIGHT, F.lit(0.0)), F.lit(1.0)).alias("cy"),
            F.least(F.col("box") / WIDTH, F.lit(1.0)).alias("w"), F.least(F.col("box") / HEIGHT, F.lit(1.0)).alias("h"),
        )
        parts = grid if parts is None else parts.unionByName(grid)
    w = Window.orderBy("level", "i", "j", "k")
    return parts.withColumn("ord", (F.row_number().over(w) - 1).cast("int")).select("ord", "cx", "cy", "w", "h")


def decode(prior: dict[str, Column], d: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """A box in pixels from a prior and its four offsets, clamped to the image."""
    cx = prior["cx"] + d["dx"] * VARIANCES[0] * prior["w"]
    cy = prior["cy"] + d["dy"] * VARIANCES[0] * prior["h"]
    w, h = prior["w"] * F.exp(d["dw"] * VARIANCES[1]), prior["h"] * F.exp(d["dh"] * VARIANCES[1])
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x1, y1, x2, y2 = clamp(cx - w / 2), clamp(cy - h / 2), clamp(cx + w / 2), clamp(cy + h / 2)
    return {"x": x1 * width, "y": y1 * height, "width": (x2 - x1) * width, "height": (y2 - y1) * height}


def normalise(pixels: np.ndarray, mean: float = 127.0, scale: float = 128.0) -> np.ndarray:
    """Interleaved RGB bytes to planes of floats."""
    return np.moveaxis((pixels.astype(np.float32) - mean) / scale, -1, 0)


def luminance(pixels: np.ndarray) -> np.ndarray:
    return pixels[..., 0] * 0.299 + pixels[..., 1] * 0.587 + pixels[..., 2] * 0.114


def edge_density(pixels: np.ndarray, step: int = 2, threshold: float = 25.0) -> np.ndarray:
    """Per row, the share of pixels whose luminance differs from the one `step` to the left by more than threshold."""
    d = np.abs(np.diff(luminance(pixels)[:, ::step], axis=1))
    return (d > threshold).mean(axis=1)


def bands(flags: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """(start, height) of the runs of set flags with a height within bounds."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [(int(a), int(b - a)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if least <= b - a <= most]


def text_lines(pixels: np.ndarray, density: float = 0.12, least: int = 8, most: int = 45) -> list[dict]:
    """Text-like strips of an image."""
    width = pixels.shape[1]
    return [{"x": 12, "y": y, "width": width - 24, "height": h, "confidence": 0.86} for y, h in bands(edge_density(pixels) > density, least, most)]


def redact_pixels(pixels: np.ndarray, regions: list[dict], blur: int = 14) -> np.ndarray:
    """Regions painted over in order: blackout black, mask grey, blur by a box mean."""
    out = pixels.copy()
    for r in regions:
        y0, y1 = max(0, int(r["y"])), max(0, int(r["y"] + r["height"]))
        x0, x1 = max(0, int(r["x"])), max(0, int(r["x"] + r["width"]))
        part = out[y0:y1, x0:x1]
        if not part.size:
            continue
        if r["redaction"] == "blackout":
            part[..., :3] = 0
        elif r["redaction"] == "mask":
            part[..., :3] = (108, 117, 125)
        else:
            part[..., :3] = _box_mean(part[..., :3].astype(np.float64), blur).round().astype(out.dtype)
    return out


def _box_mean(a: np.ndarray, reach: int) -> np.ndarray:
    for axis in (0, 1):
        n = a.shape[axis]
        total = np.concatenate([np.zeros_like(np.take(a, [0], axis)), np.cumsum(a, axis)], axis)
        lo, hi = np.maximum(np.arange(n) - reach, 0), np.minimum(np.arange(n) + reach + 1, n)
        shape = [1] * a.ndim
        shape[axis] = n
        a = (np.take(total, hi, axis) - np.take(total, lo, axis)) / (hi - lo).reshape(shape)
    return a
