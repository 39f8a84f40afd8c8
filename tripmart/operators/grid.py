"""Points in boxes by an equi-join on grid cells, never by comparing all points with all boxes.

A box is entered under the cells it touches, in a grid whose cells are at least a quarter of its longer side, so a box of
any size has at most 25 entries. A point looks up one cell in each grid that some box uses; the exact test follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("min_x", "min_y", "max_x", "max_y")
#: Cells of the finest grid have this side, in the unit of the coordinates; each coarser grid doubles it.
CELL = 0.125
#: Cells along the longer side of a box, before those at its ends.
SPAN = 4


def _usable(values: Sequence[Column]) -> Column:
    """Coordinates that a cell can be computed from; NaN and the infinite ones lie in no box."""
    out = F.lit(True)
    for v in values:
        out = out & v.between(-1e9, 1e9)
    return out


def _cell(value: Column, level: Column, cell: float) -> Column:
    return F.floor(value / (F.lit(cell) * F.pow(F.lit(2.0), level))).cast("long")


def box_cells(boxes: DataFrame, bounds: Sequence[str] = BOX, cell: float = CELL) -> DataFrame:
    """`boxes` with one row per cell: `_level`, `_cx`, `_cy`. Boxes with a null, not finite or reversed bound hold no point."""
    x0, y0, x1, y1 = (F.col(c) for c in bounds)
    longer = F.greatest(x1 - x0, y1 - y0)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longer, F.lit(cell)) / (cell * SPAN))).cast("int"))
    at = lambda low, high: F.sequence(_cell(low, F.col("_level"), cell), _cell(high, F.col("_level"), cell))
    return (boxes.where(_usable([x0, y0, x1, y1]) & (x0 <= x1) & (y0 <= y1)).withColumn("_level", level)
            .withColumn("_cx", F.explode(at(x0, x1))).withColumn("_cy", F.explode(at(y0, y1))))


def _met(points: DataFrame, x: str, y: str, boxes: DataFrame, bounds: Sequence[str], cell: float, how: str) -> DataFrame:
    clash = set(points.columns) & set(boxes.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    cells = box_cells(boxes, bounds, cell)
    # one number per grid in use: 40 or fewer, as sides double
    levels = sorted(r[0] for r in cells.select("_level").distinct().collect())
    px, py = F.col(x), F.col(y)
    usable = _usable([px, py])
    looked = (points.withColumn("_at", F.explode_outer(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
              .withColumn("_px", F.when(usable, _cell(px, F.col("_at"), cell)))
              .withColumn("_py", F.when(usable, _cell(py, F.col("_at"), cell))))
    x0, y0, x1, y1 = (F.col(c) for c in bounds)
    holds = ((F.col("_at") == F.col("_level")) & (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy"))
             & (px >= x0) & (px <= x1) & (py >= y0) & (py <= y1))
    return looked.join(cells, holds, how)


def in_boxes(points: DataFrame, x: str, y: str, boxes: DataFrame, bounds: Sequence[str] = BOX, cell: float = CELL) -> DataFrame:
    """Every pair of a point and a box that holds it, borders included, with the columns of both.

    Points without usable coordinates meet no box. Overlapping boxes give several rows. Columns of the two sides need
    different names. The boxes are broadcast by Spark where their size allows it; else AQE splits crowded cells.
    """
    return _met(points, x, y, boxes, bounds, cell, "inner").select(*points.columns, *boxes.columns)


def with_boxes(points: DataFrame, x: str, y: str, boxes: DataFrame, name: str, bounds: Sequence[str] = BOX, cell: float = CELL,
               found: str = "boxes") -> DataFrame:
    """Each point once, with the sorted names of the boxes that hold it (empty: none). Rows equal in all columns become one."""
    met = _met(points, x, y, boxes, bounds, cell, "left")
    return met.groupBy(*points.columns).agg(F.sort_array(F.collect_set(name)).alias(found))
