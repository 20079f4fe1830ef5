"""Geometry metadata and bounding boxes of row groups, as expressions on one row. No step shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import BBOX, EDGES, as_double, column_by_segments, finite
from .blocks import with_totals

_PATHS = "struct<xmin: array<string>, ymin: array<string>, xmax: array<string>, ymax: array<string>>"
#: Entries of columns stay texts, so that one that is no object cannot spoil the others.
_GEO = "struct<version: string, primary_column: string, columns: map<string, string>>"
_ENTRY = f"struct<encoding: string, geometry_types: array<string>, bbox: array<double>, crs: struct<id: struct<authority: string, code: string>>, covering: struct<bbox: {_PATHS}>>"
NOT_GEO = "no readable geo metadata: not GeoParquet; trying a bbox struct"
BAD_COVERING = "covering without a usable path for "


def geo_metadata(json: Column) -> Column:
    """The parsed footer text; null where it is missing, empty, no valid JSON, or JSON null."""
    parsed = F.try_parse_json(json)
    bad = parsed.isNull() | F.is_variant_null(parsed)
    return F.when(~F.coalesce(bad, F.lit(True)), F.from_json(json, _GEO))


def primary_entry(geo: Column) -> Column:
    """The primary column's entry; null where there is none or it is no object. Other columns' entries are not looked at."""
    text = F.try_element_at(geo["columns"], geo["primary_column"])
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, _ENTRY))


def crs(geo: Column) -> Column:
    """Authority:code of the primary column; the default where its entry names none; null without an entry."""
    entry = primary_entry(geo)
    ident = entry["crs"]["id"]
    named = ident["authority"].isNotNull() & ident["code"].isNotNull()
    return F.when(named, F.concat_ws(":", ident["authority"], ident["code"])).when(entry.isNotNull(), F.lit("OGC:CRS84"))


def declared_covering(geo: Column) -> tuple[Column, Column]:
    """(paths, key at fault): all four edges need a path; the first without one rejects the whole."""
    box = primary_entry(geo)["covering"]["bbox"]
    fault = None
    for e in EDGES:
        bad = F.coalesce(F.size(box[e]), F.lit(0)) < 1
        fault = F.when(bad, e) if fault is None else fault.when(bad, e)
    fault = F.when(box.isNotNull(), fault)
    return F.when(box.isNotNull() & fault.isNull(), box).cast(_PATHS), fault


def cut(paths: Column) -> Column:
    """Dotted paths as lists of names, for catalogs that have nothing better."""
    return F.transform(paths, lambda p: F.split(p, r"\."))


def detected_struct(segments: Column) -> Column:
    """Paths [bbox, <edge>] among those of row group 0; the edge in any case, the last one wins, all four needed. A flat
    column that is named "bbox.xmin" is one name, not two."""

    def last(edge: str) -> Column:
        like = lambda s: (F.size(s) == 2) & (F.get(s, F.lit(0)) == "bbox") & (F.lower(F.get(s, F.lit(1))) == edge)
        found = F.filter(segments, like)
        return F.try_element_at(found, F.lit(-1)).alias(edge)

    found = [last(e) for e in EDGES]
    made = F.struct(*found)
    whole = found[0].isNotNull() & found[1].isNotNull() & found[2].isNotNull() & found[3].isNotNull()
    return F.when(whole, made).cast(_PATHS)


def native_box(columns: Column, primary: Column) -> tuple[Column, Column]:
    """(box, geometry types) from the primary column's own statistics; only xmin must be finite."""
    c = column_by_segments(F.array(primary), columns)
    ok = finite(c["geo_bbox"]["xmin"])
    return F.when(ok, c["geo_bbox"]), F.when(ok, c["geo_types"])


def covering_box(columns: Column, paths: Column) -> Column:
    """The box from the bounds of the four covering columns; null if any is missing or not finite."""
    edges = []
    for e in EDGES:
        c = column_by_segments(paths[e], columns)
        edges.append(as_double(c["min_raw" if e.endswith("min") else "max_raw"]).alias(e))
    ok = finite(edges[0]) & finite(edges[1]) & finite(edges[2]) & finite(edges[3])
    return F.when(paths.isNotNull() & ok, F.struct(*edges)).cast(BBOX)


def struct_like(paths: Column) -> Column:
    """Whether all four paths are [bbox, something]."""
    out = F.lit(True)
    for e in EDGES:
        out &= (F.size(paths[e]) == 2) & (F.get(paths[e], F.lit(0)) == "bbox")
    return F.coalesce(out, F.lit(False))


def catalog(raw: DataFrame) -> DataFrame:
    """Raw row groups with totals, primary column, version, CRS, warnings, box, box source and geometry types."""
    r = raw.withColumn("_geo", geo_metadata(F.col("geo_json")))
    paths, fault = declared_covering(F.col("_geo"))
    r = r.withColumns({"_declared": paths, "_fault": fault})
    names = F.coalesce("rg0_segments", cut(F.col("rg0_paths"))) if "rg0_segments" in raw.columns else cut(F.col("rg0_paths"))
    r = r.withColumn("_paths", F.coalesce("_declared", detected_struct(names)))
    box, types = native_box(F.col("columns"), F.col("_geo.primary_column"))
    r = r.withColumns({"_native": box, "geometry_types": types, "_cover": covering_box(F.col("columns"), F.col("_paths"))})
    source = (
        F.when(F.col("_native").isNotNull(), "native")
        .when(F.col("_cover").isNotNull() & struct_like(F.col("_paths")), "bbox-struct")
        .when(F.col("_cover").isNotNull(), "covering")
        .otherwise("unavailable")
    )
    warnings = F.array_compact(F.array(
        F.when(F.col("_geo").isNull(), F.lit(NOT_GEO)), F.when(F.col("_fault").isNotNull(), F.concat(F.lit(BAD_COVERING), F.col("_fault")))))
    r = r.withColumns({
        "primary_column": F.col("_geo.primary_column"), "geo_version": F.col("_geo.version"), "crs": crs(F.col("_geo")),
        "warnings": warnings, "bbox": F.coalesce("_native", "_cover"), "bbox_source": source,
    })
    return with_totals(r.drop("_geo", "_declared", "_fault", "_paths", "_native", "_cover"))
