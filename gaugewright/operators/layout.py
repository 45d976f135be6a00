"""Boxes, colours and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(boxes: DataFrame, page: str, ident: str, slack: float = 4.0, cell: float = 256.0) -> DataFrame:
    """Pairs of boxes (left, top, right, bottom) of one page that overlap by more than ``slack`` both ways and are not nested.

    Boxes meet through the grid cells they cover, so distant ones are never compared; a pair counts in its first cell only.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    placed = boxes.withColumn("cx", F.explode(span("left", "right"))).withColumn("cy", F.explode(span("top", "bottom")))
    a, b = (placed.select(page, "cx", "cy", *(F.col(c).alias(f"{s}_{c}") for c in (ident, "left", "top", "right", "bottom"))) for s in "ab")
    c = F.col
    width = F.least(c("a_right"), c("b_right")) - F.greatest(c("a_left"), c("b_left"))
    height = F.least(c("a_bottom"), c("b_bottom")) - F.greatest(c("a_top"), c("b_top"))
    inside = lambda x, y: (c(f"{x}_left") >= c(f"{y}_left")) & (c(f"{x}_right") <= c(f"{y}_right")) & (c(f"{x}_top") >= c(f"{y}_top")) & (c(f"{x}_bottom") <= c(f"{y}_bottom"))
    first = (c("cx") == F.floor(F.greatest(c("a_left"), c("b_left")) / cell)) & (c("cy") == F.floor(F.greatest(c("a_top"), c("b_top")) / cell))
    pairs = a.join(b, [page, "cx", "cy"]).where((c(f"a_{ident}") < c(f"b_{ident}")) & first & (width > slack) & (height > slack) & ~inside("a", "b") & ~inside("b", "a"))
    return pairs.select(page, f"a_{ident}", f"b_{ident}", width.alias("width"), height.alias("height"))


def quantise(channel: Column, step: int = 32) -> Column:
    return (F.round(channel / step) * step).cast("int")


def colour_distance(a: list[Column], b: list[Column]) -> Column:
    """Squared distance of two colours."""
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0))


def yiq_delta(a: list[Column], b: list[Column]) -> Column:
    """Perceived difference of two opaque colours: weighted squares in luma and two chroma axes."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    luma = 0.29889531 * d[0] + 0.58662247 * d[1] + 0.11448223 * d[2]
    inphase = 0.59597799 * d[0] - 0.27417610 * d[1] - 0.32180189 * d[2]
    quadrature = 0.21147017 * d[0] - 0.52261711 * d[1] + 0.31114694 * d[2]
    return 0.5053 * luma * luma + 0.299 * inphase * inphase + 0.1957 * quadrature * quadrature
