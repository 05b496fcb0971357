"""Spatial joins by cells: polygons covered by cells, points within them, and exact nearest neighbours by growing cells.

A cell is a square of ``step`` by its column ``i`` and row ``j``.  A polygon is edges ``(poly, x1, y1, x2, y2)``; its border
cells are those that an edge may touch, its inside cells those between the crossings of a row's middle that no edge touches.  A
point in an inside cell is inside; only points in border cells meet edges, and of these only the ones that reach their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationwise.functions.exprs import haversine_km

#: Borders are widened by this share of a cell, against rounding.
_SLACK = 1e-9
#: Kilometres in a degree of latitude, rounded down.
KM_PER_DEGREE = 111.19
#: Halvings from a group's extent to its smallest cells, and the share of a cell's width that surely lies within its neighbours.
DEPTH, SURE = 16, 0.9


def strips(edges: DataFrame, step: float) -> DataFrame:
    """The edges by the rows of cells that they reach: ``(poly, j, x1, y1, x2, y2)``."""
    row = lambda y, slack: F.floor(y / step + slack).cast("long")
    return edges.withColumn("j", F.explode(F.sequence(row(F.least("y1", "y2"), -_SLACK), row(F.greatest("y1", "y2"), _SLACK))))


def _x_at(y: Column) -> Column:
    return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")


def crosses(px: Column, py: Column) -> Column:
    """Whether a ray from the point to the right crosses the edge."""
    return ((F.col("y1") > py) != (F.col("y2") > py)) & (px < _x_at(py))


def cell_cover(edges: DataFrame, step: float) -> DataFrame:
    """``(poly, i, j, kind)``: the border and inside cells of each polygon; cells that are not there lie outside."""
    s = strips(edges, step)
    low, high = (F.least(F.greatest(F.col("j") * step + d, F.least("y1", "y2")), F.greatest("y1", "y2")) for d in (0.0, step))
    ends = [F.coalesce(_x_at(y), c) for y, c in ((low, F.col("x1")), (high, F.col("x2")))]  # a level edge reaches from x1 to x2
    column = lambda x, slack: F.floor(x / step + slack).cast("long")
    border = s.select("poly", "j", F.explode(F.sequence(column(F.least(*ends), -_SLACK), column(F.greatest(*ends), _SLACK))).alias("i")).distinct()
    middle = (F.col("j") + 0.5) * step
    crossed = s.where((F.col("y1") > middle) != (F.col("y2") > middle)).groupBy("poly", "j").agg(F.sort_array(F.collect_list(_x_at(middle))).alias("x"))  # the edges of a row
    pairs = crossed.select("poly", "j", F.explode(F.expr("transform(sequence(0, size(x) div 2 - 1), k -> struct(x[2 * k] AS a, x[2 * k + 1] AS b))")).alias("p"))
    first, last = F.ceil(F.col("p.a") / step - 0.5).cast("long"), F.floor(F.col("p.b") / step - 0.5).cast("long")
    within = pairs.where(first <= last).select("poly", "j", F.explode(F.sequence(first, last)).alias("i"))
    inside = within.join(border, ["poly", "i", "j"], "left_anti")
    return inside.select("poly", "i", "j", F.lit("inside").alias("kind")).union(border.select("poly", "i", "j", F.lit("border").alias("kind")))


def points_in(points: DataFrame, edges: DataFrame, x: str, y: str, key: str, step: float) -> DataFrame:
    """``(poly, key)`` for each point inside a polygon, whose key tells it apart; points without a place are in none."""
    at = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = at.select(F.col(key), F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(x) / step).cast("long").alias("i"), F.floor(F.col(y) / step).cast("long").alias("j"))
    met = at.join(cell_cover(edges, step), ["i", "j"])
    tested = met.where("kind = 'border'").join(strips(edges, step), ["poly", "j"]).where(crosses(F.col("_x"), F.col("_y")))
    odd = tested.groupBy("poly", key).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1")
    return met.where("kind = 'inside'").select("poly", key).union(odd.select("poly", key))


def quadrature_points(edges: DataFrame, step: float, side: int) -> DataFrame:
    """``(poly, gx, gy, x, y)``: the middles of a grid of ``side`` by ``side`` squares a cell that lie inside a polygon."""
    spacing = step / side
    cells = cell_cover(edges, step)
    for g, c in (("gx", "i"), ("gy", "j")):
        cells = cells.withColumn(g, F.explode(F.sequence(F.col(c) * side, F.col(c) * side + side - 1)))
    grid = cells.select("poly", "gx", "gy", ((F.col("gx") + 0.5) * spacing).alias("x"), ((F.col("gy") + 0.5) * spacing).alias("y"), "j", "kind")
    tested = grid.where("kind = 'border'").join(strips(edges, step), ["poly", "j"]).where(crosses(F.col("x"), F.col("y")))
    odd = tested.groupBy("poly", "gx", "gy", "x", "y").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").drop("_n")
    return grid.where("kind = 'inside'").select("poly", "gx", "gy", "x", "y").union(odd)


def k_nearest(points: DataFrame, targets: DataFrame, k: int, group: str, depth: int = DEPTH) -> DataFrame:
    """``(group, a, b, place, km)``: the ``k`` nearest ``targets(group, b, lat, lon)`` of each of ``points(group, a, lat, lon)``, exactly.

    A group's extent is halved ``depth`` times.  Each point takes the smallest of its cells that hold ``k`` targets beside
    itself: the k-th nearest is no farther than that cell is across, so it lies in a cell so wide, or a neighbour of it, and only
    targets there are measured.  Points of a dense place look at small cells and lone ones at large ones.  Equal distances go by ``b``; a target with the point's own id is not its
    neighbour; fewer than ``k`` targets are all there.  Places are degrees, and extents do not cross the 180th meridian.
    """
    top, none = depth + 1, F.col("lat").isNotNull() & F.col("lon").isNotNull()
    points, targets = points.where(none).select(group, "a", "lat", "lon"), targets.where(none).select(group, "b", "lat", "lon")
    both = points.select(group, "lat", "lon").union(targets.select(group, "lat", "lon"))
    box = both.groupBy(group).agg(*[f(c).alias(f"_{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))], F.max(F.abs("lat")).alias("_far"), F.min(F.abs("lat")).alias("_near"))
    narrow, wide = F.cos(F.radians("_far")), F.cos(F.radians("_near"))
    extent = F.greatest(F.col("_max_lat") - F.col("_min_lat"), (F.col("_max_lon") - F.col("_min_lon")) * narrow, F.lit(1e-9))
    # a cell is nowhere narrower than it is high; across it measures so many times its height at most
    across = F.sqrt(1 + F.pow(wide / narrow, F.lit(2))) / SURE
    box = box.select(group, "_min_lat", "_min_lon", narrow.alias("_narrow"), (extent * (1 + 1e-6) / (1 << depth)).alias("_size"), F.ceil(F.log2(across)).cast("int").alias("_grow"))

    def placed(df: DataFrame) -> DataFrame:
        u = F.floor((F.col("lat") - F.col("_min_lat")) / F.col("_size")).cast("long").alias("u")
        v = F.floor((F.col("lon") - F.col("_min_lon")) * F.col("_narrow") / F.col("_size")).cast("long").alias("v")
        return df.join(box, group).select(*df.columns, "_grow", u, v)

    def at_level(df: DataFrame, level: Column) -> DataFrame:
        """With the cell that holds a place at ``level``."""
        df = df.withColumn("level", level)
        return df.withColumns({"i": F.expr("shiftright(u, level)"), "j": F.expr("shiftright(v, level)")}).drop("u", "v")

    p, t = placed(points), placed(targets)
    every = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    cell = [group, "level", "i", "j"]
    full = at_level(t.select(group, "u", "v"), every).groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k).drop("_n")
    level = at_level(p.select(group, "a", "u", "v"), every).join(full, cell).groupBy(group, "a").agg(F.min("level").alias("_level"))
    own = p.join(level, [group, "a"], "left").withColumn("_level", F.least(F.coalesce("_level", F.lit(top)) + F.col("_grow"), F.lit(top)))
    own = at_level(own, F.col("_level")).select(*cell, "a", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    for c in "ij":
        own = own.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    wanted = at_level(t, F.explode(F.sequence(F.lit(0), F.lit(top)))).join(own.select(*cell).distinct(), cell, "left_semi")
    met = own.join(wanted, cell).where(~F.col("a").eqNullSafe(F.col("b"))).select(group, "a", "b", haversine_km("_lat", "_lon", "lat", "lon").alias("km"))
    order = Window.partitionBy(group, "a").orderBy(F.round("km", 9), F.expr("try_cast(b AS bigint)"), "b")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(group, "a", "b", "place", "km")
