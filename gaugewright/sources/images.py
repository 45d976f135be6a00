"""Screenshots as rows of pixels: Spark's image source reads the files, joins and groups compare them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import yiq_delta


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(name, width, height, channels, data) of the images below a folder; damaged ones have a height of -1 and no data."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select("image.*")
    return found.select(F.substring_index("origin", "/", -1).alias("name"), "width", "height", F.col("nChannels").alias("channels"), "data")


def shots(spark: SparkSession, folder: str) -> DataFrame:
    """(page, shot) of the PNG files in folders of pages, without pictures of differences; files are listed, not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder).select(F.split("path", "/").alias("p"))
    named = found.select(F.element_at("p", -2).alias("page"), F.element_at("p", -1).alias("shot"))
    return named.where(~F.startswith("shot", F.lit("diff-"))).orderBy("page", "shot")


def pixels(images: DataFrame) -> DataFrame:
    """A row per pixel: (name, x, y, r, g, b), laid on white where there is an alpha channel."""
    c = F.col
    spread = images.where("height > 0").select("name", "width", "channels", "data", F.explode(F.sequence(F.lit(0), c("width") * c("height") - 1)).alias("i"))
    hexed = spread.select("name", (c("i") % c("width")).alias("x"), F.floor(c("i") / c("width")).cast("int").alias("y"), "channels", F.hex(F.substring(c("data"), c("i") * c("channels") + 1, c("channels"))).alias("h"))
    byte = lambda k: F.conv(F.substring("h", 2 * k + 1, 2), 16, 10).cast("int")
    alpha = F.when(c("channels") == 4, byte(3) / 255).otherwise(F.lit(1.0))
    on_white = lambda v: 255 + (v - 255) * alpha
    blue, green, red = (on_white(F.when(c("channels") == 1, byte(0)).otherwise(byte(k))) for k in range(3))
    return hexed.select("name", "x", "y", red.alias("r"), green.alias("g"), blue.alias("b"))


def compared(before: DataFrame, after: DataFrame, delta: float = 35215 * 0.1 * 0.1) -> DataFrame:
    """before and after, as ``read`` gives them -> (name, changed, total, percent, state): visibly different pixels of images of one name.

    ``state`` is same-size, size-changed, missing (gone from ``after``) or added; only the first has counts.
    """
    size = lambda df, s: df.select("name", F.col("width").alias(f"{s}_width"), F.col("height").alias(f"{s}_height"))
    both = size(before, "a").join(size(after, "b"), "name", "full")
    c = F.col
    state = F.when(c("b_width").isNull(), "missing").when(c("a_width").isNull(), "added").when((c("a_width") == c("b_width")) & (c("a_height") == c("b_height")), "same-size").otherwise("size-changed")
    named = both.select("name", state.alias("state"), (c("a_width") * c("a_height")).cast("long").alias("total"))
    same = named.where("state = 'same-size'").select("name")
    a, b = (pixels(x.join(same, "name", "left_semi")).toDF("name", "x", "y", *(f"{s}_{k}" for k in "rgb")) for x, s in ((before, "a"), (after, "b")))
    differs = yiq_delta([c("a_r"), c("a_g"), c("a_b")], [c("b_r"), c("b_g"), c("b_b")]) > delta
    counts = a.join(b, ["name", "x", "y"]).groupBy("name").agg(F.count_if(differs).alias("changed"))
    return named.join(counts, "name", "left").select("name", "changed", F.when(c("changed").isNotNull(), c("total")).alias("total"), F.round(100.0 * c("changed") / c("total"), 4).alias("percent"), "state")


def encode(width: int, height: int, rgba: bytes) -> bytes:
    """RGBA pixels as a PNG without line filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.frombuffer(rgba, np.uint8).reshape(height, width * 4)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), lines], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def encoded(width: Column, height: Column, rgba: Column) -> Column:
    """PNG bytes of images held as RGBA columns."""

    def run(w: pd.Series, h: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([encode(int(a), int(b), x) for a, b, x in zip(w, h, data, strict=True)])

    return F.pandas_udf(run, "binary")(width, height, rgba)
