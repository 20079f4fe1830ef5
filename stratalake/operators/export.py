"""Boxes as GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colours that features take in turn (fixed values).
PALETTE = ("#4f8cff", "#ff7a59", "#27c197", "#c97cff", "#ffd166", "#ef476f", "#06d6a0", "#118ab2", "#f25c54", "#8a4fff")


def color(index: Column) -> Column:
    """Palette entry by index."""
    return F.get(F.array(*[F.lit(c) for c in PALETTE]), F.pmod(index, F.lit(len(PALETTE))))


def polygon(box: Column) -> Column:
    """struct<type, coordinates> with the closed ring SW, SE, NE, NW, SW."""
    p = lambda x, y: F.array(box[x], box[y])
    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"), p("xmin", "ymin"))
    return F.when(box.isNotNull(), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def features(row_groups: DataFrame) -> DataFrame:
    """File and feature struct of each row group with a box (rg_index, bbox, visible); invisible ones stay."""
    props = F.struct(F.col("rg_index").alias("index"), color(F.col("rg_index")).alias("color"), "visible")
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("rg_index").alias("id"), polygon(F.col("bbox")).alias("geometry"), props.alias("properties")
    )
    return row_groups.where(F.col("bbox").isNotNull()).select("file", feature.alias("feature"))


def write_geojson_lines(row_groups: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON, a part per partition."""
    features(row_groups).select(F.to_json("feature")).write.text(path)
