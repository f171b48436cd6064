"""Listings and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmine.operators.align import padded


def export_listing(df: DataFrame, *, src: str = "src", pos: str = "pos", name: str = "class",
                   detail: Column | None = None) -> DataFrame:
    """One text line per classified record."""
    parts = [F.concat(F.lit("["), F.col(src).cast("string"), F.lit(":"), F.col(pos).cast("string"), F.lit("]")),
             F.coalesce(F.col(name), F.lit("Unknown"))]
    if detail is not None:
        parts.append(detail.cast("string"))
    return df.select(src, pos, F.concat_ws(" ", *parts).alias("line"))


def artifact_manifest(df: DataFrame, *, base: Column, extension: Column, content: Column,
                      width: Column | None = None, height: Column | None = None,
                      number: Column | None = None, digits: Column | None = None) -> DataFrame:
    """Output name and content digest: base, ``_WxH``, ``[number]``, extension.

    ``digits`` pads numbers with zeros, so names sort like numbers; longer numbers are not cut.
    """
    name = [base]
    if width is not None and height is not None:
        name += [F.concat(F.lit("_"), width.cast("string"), F.lit("x"), height.cast("string"))]
    if number is not None:
        shown = number.cast("string") if digits is None else padded(number, digits)
        name += [F.concat(F.lit("["), shown, F.lit("]"))]
    return (df.withColumn("artifact", F.concat(*name, F.lit("."), extension))
            .withColumn("digest", F.md5(content.cast("binary"))))
