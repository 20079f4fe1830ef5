"""Rectangles, points and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import BBOX, EDGES, finite

#: Rectangles or points are broadcast up to so many; more meet the boxes on grids.
BROADCAST_SHAPES = 50_000
#: The finest grid's cell, how much coarser each grid is than the one before, and cells that a shape may cover along one axis.
FINEST, COARSER, SPAN = 1e-7, 4.0, 4
#: Shapes of one side in one cell beyond which the cell is dealt out in blocks.
DENSE = 4096
#: Dense cells are broadcast up to so many.
BROADCAST_CELLS = 100_000
CELL = ["_k", "_cx", "_cy"]


def intersects(a: Column, b: Column) -> Column:
    """Touching edges count, NaN and missing edges exclude nothing, and no box wraps around."""
    apart = lambda x, y: F.coalesce((x < y) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))
    out = apart(a["xmax"], b["xmin"]) | apart(b["xmax"], a["xmin"]) | apart(a["ymax"], b["ymin"]) | apart(b["ymax"], a["ymin"])
    return ~out


def rect(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return F.struct(*[F.lit(float(v)).alias(e) for e, v in zip(EDGES, (xmin, ymin, xmax, ymax), strict=True)]).cast(BBOX)


def visible(matches: Column, rectangle: Column | None = None, bbox: str = "bbox") -> Column:
    """Attribute verdict and, with a rectangle, its intersection; row groups without box then go."""
    if rectangle is None:
        return matches
    return F.col(bbox).isNotNull() & intersects(F.col(bbox), rectangle) & matches


def rects_from_corners(corners: DataFrame) -> DataFrame:
    """rect_id and edges from two corners (x1, y1, x2, y2); rectangles without area go."""
    out = corners.select(
        "rect_id", F.least("x1", "x2").alias("xmin"), F.least("y1", "y2").alias("ymin"),
        F.greatest("x1", "x2").alias("xmax"), F.greatest("y1", "y2").alias("ymax"),
    )
    return out.where("xmin < xmax and ymin < ymax")


def _level(box: Column, finest: float) -> Column:
    """The finest grid on which a box spans at most SPAN cells along either axis; null for unknown or turned edges."""
    sane = finite(box["xmin"]) & finite(box["ymin"]) & finite(box["xmax"]) & finite(box["ymax"])
    sane = F.coalesce(sane & (box["xmin"] <= box["xmax"]) & (box["ymin"] <= box["ymax"]), F.lit(False))
    wide = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"]) / (finest * (SPAN - 1))
    k = F.when(wide <= 1, F.lit(0)).otherwise(F.ceil(F.log2(wide) / F.log2(F.lit(COARSER))).cast("int"))
    return F.when(sane & finite(wide), k)


def _size(finest: float) -> Column:
    return F.lit(finest) * F.pow(F.lit(COARSER), F.col("_k"))


def _in_cells(shapes: DataFrame, box: str, k: Column, finest: float) -> DataFrame:
    """shapes once for each cell that they touch on grid k."""
    at = lambda e: F.floor(F.col(box)[e] / _size(finest))
    out = shapes.withColumn("_k", k)
    return out.withColumn("_cx", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("_cy", F.explode(F.sequence(at("ymin"), at("ymax"))))


def _profile(b: DataFrame, r: DataFrame, finest: float) -> tuple[dict, dict]:
    """Shapes of either side by their own grid (None: without four sane edges), in one pass: a grid for each power of size, so few."""
    levels = b.select(F.lit(0).alias("side"), _level(F.col("bbox"), finest).alias("k")).unionByName(r.select(F.lit(1).alias("side"), _level(F.col("rect"), finest).alias("k")))
    out: tuple[dict, dict] = ({}, {})
    for x in levels.groupBy("side", "k").agg(F.count("*").alias("n")).collect():
        out[x["side"]][x["k"]] = x["n"]
    return out


def _dense_cells(meetings: list[tuple[DataFrame, DataFrame]]) -> list[DataFrame | None]:
    """For each pair of sides the cells where one of them is dense and into how many blocks either is dealt (None: there are none)."""
    every = []
    for i, (own, copies) in enumerate(meetings):
        per_cell = own.groupBy(*CELL).agg(F.count("*").alias("_m")).join(copies.groupBy(*CELL).agg(F.count("*").alias("_n")), CELL)
        dense = per_cell.where((F.col("_m") > DENSE) | (F.col("_n") > DENSE))
        every.append(dense.select(*CELL, F.ceil(F.col("_m") / DENSE).cast("int").alias("_bi"), F.ceil(F.col("_n") / DENSE).cast("int").alias("_bj"), F.lit(i).alias("_d")))
    both = every[0]
    for x in every[1:]:
        both = both.unionByName(x)
    found = both.limit(BROADCAST_CELLS + 1).collect()
    if len(found) > BROADCAST_CELLS:
        return [x.drop("_d") for x in every]
    session = both.sparkSession
    mine = [[r for r in found if r["_d"] == i] for i in range(len(every))]
    return [F.broadcast(session.createDataFrame(rows, both.schema).drop("_d")) if rows else None for rows in mine]


def _meeting(own: DataFrame, copies: DataFrame, left: list[str], right: list[str], dense: DataFrame | None) -> DataFrame:
    """Rows of own beside rows of copies in the same cell. A dense cell is dealt out: its rows lie in blocks by hash, and every pair
    of blocks meets in a place of its own, so that no task holds more than a block of each side."""
    if dense is None:
        return own.join(copies, CELL)

    def dealt(df: DataFrame, names: list[str], mine: str, other: str) -> DataFrame:
        df = df.join(dense, CELL, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_bi", "_bj")})
        mark = F.pmod(F.xxhash64(*names), F.col(f"_b{mine}")).cast("int")
        return df.withColumn(f"_{mine}", mark).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_b{other}") - 1))).drop("_bi", "_bj")

    return dealt(own, left, "i", "j").join(dealt(copies, right, "j", "i"), [*CELL, "_i", "_j"])


def range_candidates(boxes: DataFrame, rects: DataFrame, finest: float = FINEST, profile: tuple[dict, dict] | None = None) -> DataFrame:
    """Pairs of a row of boxes (with bbox) and a row of rects (with rect) that share a cell, for shapes with four sane edges.

    A shape's own grid is the finest one that suits its size. A pair meets on the coarser of the two own grids only: there one
    of them lies in its own cells and the other in a copy, which is made for grids that the other side really has. So shapes of one size
    meet in cells of that size, and the pairs tried follow the pairs found. Columns: those of both sides, _k, _cx, _cy; a pair
    may come once for each cell that both touch.
    """
    profile = profile or _profile(boxes, rects, finest)
    b, r = boxes.withColumn("_l", _level(F.col("bbox"), finest)).where("_l is not null"), rects.withColumn("_l", _level(F.col("rect"), finest)).where("_l is not null")
    meetings, names = [], []
    for own, copies, box, rect, side, columns in ((b, r, "bbox", "rect", 0, (boxes.columns, rects.columns)), (r, b, "rect", "bbox", 1, (rects.columns, boxes.columns))):
        every = F.array(*[F.lit(k) for k in sorted(k for k in profile[side] if k is not None)]).cast("array<int>")
        coarser = F.filter(every, lambda k: k > F.col("_l")) if side else F.filter(every, lambda k: k >= F.col("_l"))
        meetings.append((_in_cells(own, box, F.col("_l"), finest).drop("_l"), _in_cells(copies, rect, F.explode(coarser), finest).drop("_l")))
        names.append(columns)
    few = max(sum(side.values()) for side in profile) <= DENSE
    dense = [None, None] if few else _dense_cells(meetings)
    pairs = [_meeting(*m, *n, d).select(*boxes.columns, *rects.columns, *CELL) for m, n, d in zip(meetings, names, dense, strict=True)]
    return pairs[0].unionByName(pairs[1])


def _all_pairs(few: DataFrame, others: DataFrame, n_others: int, block: int) -> DataFrame:
    """Every row of few beside every row of others: others lie in blocks by hash and few goes to each, so that neither side
    is ever held whole. For shapes without four sane edges, which may touch anything."""
    blocks = max(1, -(-n_others // block))
    dealt = others.withColumn("_block", F.pmod(F.xxhash64(*others.columns), F.lit(blocks)).cast("int"))
    return few.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "_block").drop("_block")


def range_join(boxes: DataFrame, rects: DataFrame, how: str = "auto", finest: float = FINEST) -> DataFrame:
    """Every pair of a row of boxes (with bbox) and a row of rects (with rect) that intersect.

    how: "auto" tests each box against the broadcast rectangles behind a check of their number, and beyond it takes "grid":
    equality joins on (grid, cell), see range_candidates; a pair counts in the one cell that holds the lower left corner of the common
    part, so that it never comes twice. Boxes and rectangles without four sane edges meet all of the other side, in blocks.
    """
    b = boxes.where(F.col("bbox").isNotNull())
    test = intersects(F.col("bbox"), F.col("rect"))
    if how == "auto" and rects.limit(BROADCAST_SHAPES + 1).count() <= BROADCAST_SHAPES:
        return b.join(F.broadcast(rects), test)
    names = [*boxes.columns, *rects.columns]
    low = lambda e: F.floor(F.greatest(F.col("bbox")[e], F.col("rect")[e]) / _size(finest))
    profile = _profile(b, rects, finest)
    corner = (F.col("_cx") == low("xmin")) & (F.col("_cy") == low("ymin"))
    out = range_candidates(b, rects, finest, profile).where(corner & test).select(*names)
    odd_b, odd_r = _level(F.col("bbox"), finest).isNull(), _level(F.col("rect"), finest).isNull()
    if profile[0].get(None):
        out = out.unionByName(_all_pairs(b.where(odd_b), rects, sum(profile[1].values()), BROADCAST_SHAPES).where(test).select(*names))
    if profile[1].get(None):
        out = out.unionByName(_all_pairs(rects.where(odd_r), b.where(~odd_b), sum(profile[0].values()), BROADCAST_SHAPES).where(test).select(*names))
    return out


def point_candidates(boxes: DataFrame, points: DataFrame, how: str = "auto", finest: float = FINEST) -> DataFrame:
    """point_id, file, rg_index of the visible boxes (file, rg_index, bbox, visible) that hold a point, in order.

    Edges belong to the box. A point is a rectangle without extent, so that the range join does the work.
    """
    p = points.select("point_id", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")).cast(BBOX).alias("rect"))
    known = F.col("rect.xmin").isNotNull() & F.col("rect.ymin").isNotNull() & ~F.isnan("rect.xmin") & ~F.isnan("rect.ymin")
    drawn = boxes.where("visible").select("file", "rg_index", "bbox")
    hit = range_join(drawn, p.where(known), how, finest)
    return hit.select("point_id", "file", "rg_index").distinct().orderBy("point_id", "file", "rg_index")


def extent(row_groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By, the edges over all boxes (NaN left out), and mode: none, point or bounds."""
    real = lambda e: F.when(~F.isnan(F.col("bbox")[e]), F.col("bbox")[e])
    aggs = [(F.min if e.endswith("min") else F.max)(real(e)).alias(e) for e in EDGES]
    g = row_groups.groupBy(*(by or [])).agg(*aggs)
    width, height = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    mode = F.when(~(finite(width) & finite(height)), "none").when((width == 0) & (height == 0), "point").otherwise("bounds")
    return g.withColumn("mode", mode)
