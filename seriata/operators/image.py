"""Pixel tables (image_id, y, x, v) and small arrays: block reduction, montage, correlation, masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components


def block_reduce(pixels: DataFrame, factor: int, how: str = "mean") -> DataFrame:
    """image_id, y, x, v of blocks of factor x factor pixels: mean or median, truncated to a grey level."""
    value = F.avg("v") if how == "mean" else F.median("v")
    return pixels.groupBy("image_id", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.floor(value).cast("int").alias("v"))


def upsample(pixels: DataFrame, factor: int) -> DataFrame:
    """Each pixel as factor x factor equal ones."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(factor) for j in range(factor)))
    return pixels.withColumn("s", F.explode(steps)).select("image_id", (F.col("y") * factor + F.col("s.i")).alias("y"), (F.col("x") * factor + F.col("s.j")).alias("x"), "v")


def montage(pixels: DataFrame, places: DataFrame) -> DataFrame:
    """y, x, v, overlap: images (image_id, ord, x0, y0) set at rounded places; later ones cover earlier ones; overlap counts the covering images. Images without a place are left out."""
    at = places.where("x0 is not null and y0 is not null").select("image_id", "ord", F.bround("x0").cast("long").alias("x0"), F.bround("y0").cast("long").alias("y0"))
    set_ = pixels.join(at, "image_id").select((F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), "v", "ord")
    return set_.groupBy("y", "x").agg(F.max_by("v", "ord").alias("v"), F.count("*").alias("overlap"))


def feather(pixels: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """y, x, v: mean of the covering images weighted by the distance to their border, up to width."""
    size = pixels.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    edge = F.least(F.col("y") + 1, F.col("x") + 1, F.col("h") - F.col("y") + 1, F.col("w") - F.col("x") + 1)
    weighed = pixels.join(F.broadcast(size), "image_id").withColumn("weight", F.least(edge / width, F.lit(1.0)))  # a row per image
    at = places.where("x0 is not null and y0 is not null").select("image_id", F.bround("x0").cast("long").alias("x0"), F.bround("y0").cast("long").alias("y0"))
    set_ = weighed.join(at, "image_id").groupBy((F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"))
    return set_.agg(F.bround(F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).cast("int").alias("v"))


def mask_components(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """image_id, y, x, component: connected pixels of a mask table (image_id, y, x), named by their smallest pixel."""
    node = F.xxhash64("image_id", "y", "x")
    m = mask.select("image_id", "y", "x").distinct()
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    moved = m.withColumn("s", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))))
    near = moved.select(node.alias("src"), "image_id", (F.col("y") + F.col("s.i")).alias("y"), (F.col("x") + F.col("s.j")).alias("x")).join(m, ["image_id", "y", "x"])
    found = components(m.select(node.alias("node")), near.select("src", F.xxhash64("image_id", "y", "x").alias("dst")))
    return m.withColumn("node", node).join(found, "node").select("image_id", "y", "x", "component")


def clean_mask(mask: DataFrame, least: int, diagonal: bool = True) -> DataFrame:
    """The mask without components of fewer than least pixels; an image whose components are all small keeps its largest."""
    c = mask_components(mask, diagonal)
    size = c.groupBy("image_id", "component").agg(F.count("*").alias("n"))
    top = size.groupBy("image_id").agg(F.max(F.struct("n", -F.col("component"))).alias("t"))
    keep = size.join(top, "image_id").where((F.col("n") >= least) | ((F.col("t.n") < least) & (F.col("n") == F.col("t.n")) & (-F.col("component") == F.col("t.col2"))))
    return c.join(keep.select("image_id", "component"), ["image_id", "component"]).select("image_id", "y", "x")


def fill_background(pixels: DataFrame, share: float = 0.0016, fill: int = 128) -> DataFrame:
    """Pixels with every component of zeros larger than a share of the image's area filled."""
    area = pixels.groupBy("image_id").agg(F.count("*").alias("area"))
    zero = mask_components(pixels.where("v = 0"))
    large = zero.groupBy("image_id", "component").agg(F.count("*").alias("n")).join(area, "image_id").where(F.col("n") > share * F.col("area"))
    gone = zero.join(large.select("image_id", "component"), ["image_id", "component"]).select("image_id", "y", "x", F.lit(True).alias("gone"))
    return pixels.join(gone, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.when(F.col("gone"), fill).otherwise(F.col("v")).alias("v"))


def normxcorr(template: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every overlap of template and image ("full"); 0 where either has no variance under it.

    Products by FFT, local sums by the same transform of the image and its square.
    """
    template, image = template.astype(float), image.astype(float)
    shape = [a + b - 1 for a, b in zip(template.shape, image.shape, strict=True)]
    fft = lambda x: np.fft.rfft2(x, shape)
    t = template - template.mean()
    product = np.fft.irfft2(fft(image) * fft(t[::-1, ::-1]), shape)
    box = fft(np.ones_like(template))
    total, square = np.fft.irfft2(fft(image) * box, shape), np.fft.irfft2(fft(image * image) * box, shape)
    spread = np.maximum(0, square - total * total / template.size) * (t * t).sum()
    floor = 1e-9 * max(1.0, float((image * image).sum())) * max(1.0, float((t * t).sum()))
    return np.where(spread > floor, product / np.sqrt(np.maximum(spread, floor)), 0.0)


def best_offset(template: np.ndarray, image: np.ndarray, border: int = 0) -> tuple[float, int, int]:
    """(correlation, dy, dx) of the peak, first in row-major order; offsets put the template's corner in the image. border cuts the rim of overlaps."""
    c = normxcorr(template, image)
    if border:
        c = c[border:-border, border:-border]
    y, x = np.unravel_index(int(np.argmax(np.round(c, 12))), c.shape)
    return float(c[y, x]), int(y) + border - template.shape[0] + 1, int(x) + border - template.shape[1] + 1


def correlate_pairs(images: DataFrame, edges: DataFrame, border: int = 0) -> DataFrame:
    """src, dst, corr, dy, dx of edges between images (image_id, height, width, data: array of grey levels, row by row)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, b = (np.array(r[f"d{k}"], float).reshape(r[f"h{k}"], r[f"w{k}"]) for k in "ab")
                rows.append((r["src"], r["dst"], *best_offset(a, b, border)))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["src", "dst", "corr", "dy", "dx"])

    side = lambda key, k: images.select(F.col("image_id").alias(key), F.col("height").alias(f"h{k}"), F.col("width").alias(f"w{k}"), F.col("data").alias(f"d{k}"))
    return edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst").mapInArrow(run, "src long, dst long, corr double, dy int, dx int")
