"""Points and areas: which area holds a point, the nearest one, and the passes that settle a whole table.

Areas are rows of ``name`` and ``ring``. Points meet areas through cells of a grid, an equality join: an area is listed under
the cells that its bounds touch, a point under its own, and only then is the ring itself tested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import rank
from waymark.functions import geo
from waymark.operators.aggregates import pulled
from waymark.operators.joins import nearest_number
from waymark.stage import cut


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def gridded(areas: DataFrame, size: float) -> DataFrame:
    """Areas by the cells that their bounds touch."""
    b = areas.withColumn("_b", geo.bounds(F.col("ring"))).where("size(ring) >= 3")
    span = lambda lo, hi: F.explode(F.sequence(_cell(F.col(lo), size), _cell(F.col(hi), size)))
    return b.withColumn("_cx", span("_b.west", "_b.east")).withColumn("_cy", span("_b.south", "_b.north"))


def containing(points: DataFrame, areas: DataFrame, x: str, y: str, size: float = 0.05) -> DataFrame:
    """A row for each point and area that holds it, borders included (C15): ``area`` and ``edge``, the distance to its border."""
    held = gridded(areas, size).select(F.col("name").alias("area"), "ring", "_b", "_cx", "_cy")
    at = points.withColumns({"_cx": _cell(F.col(x), size), "_cy": _cell(F.col(y), size)})
    near = at.join(held, ["_cx", "_cy"]).where(F.col(x).between(F.col("_b.west"), F.col("_b.east")) & F.col(y).between(F.col("_b.south"), F.col("_b.north")))
    inside = near.where(geo.in_ring(F.col(x), F.col(y), F.col("ring")))
    return inside.withColumn("edge", geo.edge_distance(F.col(x), F.col(y), F.col("ring"))).drop("_cx", "_cy", "_b", "ring")


def nearest(points: DataFrame, areas: DataFrame, row_id: str, x: str, y: str, size: float = 0.05) -> DataFrame:
    """``area`` and ``edge`` of the area whose border is nearest to each point (C16), ties by name.

    Points meet areas through cells of a grid again, whose cells are as wide as the search reaches: an area is listed under
    the cells round its bounds too. Points whose nearest border is farther go into the next round, four times as wide, until the
    reach is that of all points and areas together.
    """
    held = areas.where("size(ring) >= 2").select("name", "ring", geo.bounds(F.col("ring")).alias("_b"))
    left = cut(points.select(row_id, F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x is not null and _y is not null"))
    spans = held.select(F.col("_b.west").alias("x"), F.col("_b.south").alias("y")).unionByName(held.select(F.col("_b.east").alias("x"), F.col("_b.north").alias("y"))).unionByName(left.selectExpr("_x as x", "_y as y"))
    whole = spans.agg((F.max("x") - F.min("x") + F.max("y") - F.min("y")).alias("reach")).first().reach or 0.0
    reach, found = size, None
    while True:
        span = lambda lo, hi: F.explode(F.sequence(_cell(F.col(lo) - reach, reach), _cell(F.col(hi) + reach, reach)))  # noqa: B023, E731
        listed = held.withColumn("_cx", span("_b.west", "_b.east")).withColumn("_cy", span("_b.south", "_b.north"))
        near = left.withColumns({"_cx": _cell(F.col("_x"), reach), "_cy": _cell(F.col("_y"), reach)}).join(listed, ["_cx", "_cy"])
        near = near.select(row_id, geo.edge_distance(F.col("_x"), F.col("_y"), F.col("ring")).alias("edge"), "name").where(F.col("edge") <= reach)
        best = cut(near.groupBy(row_id).agg(F.min(F.struct("edge", "name")).alias("b")))
        found = best if found is None else found.unionByName(best)
        if reach > whole:
            break
        left = cut(left.join(best, row_id, "left_anti"))
        if left.isEmpty():
            break
        reach *= 4
    return points.join(found.select(row_id, F.col("b.name").alias("area"), F.col("b.edge").alias("edge")), row_id, "left")


def deepest(points: DataFrame, areas: DataFrame, row_id: str, x: str, y: str, size: float = 0.05) -> DataFrame:
    """The area that holds a point deepest (K4); null outside all. Ties go to the first name."""
    inside = containing(points.select(row_id, x, y), areas, x, y, size).groupBy(row_id, "area").agg(F.max("edge").alias("edge"))
    best = inside.groupBy(row_id).agg(F.min(F.struct((-F.col("edge")).alias("d"), "area")).alias("b"))
    return points.join(best.select(row_id, F.col("b.area").alias("area")), row_id, "left")


def assigned(points: DataFrame, areas: DataFrame, row_id: str, x: str, y: str, size: float = 0.05) -> DataFrame:
    """``kind`` and ``areas`` of each point (K5): IN one, BORDER of several (sorted), NEAREST to one, null without coordinates."""
    inside = containing(points.select(row_id, x, y), areas, x, y, size).groupBy(row_id).agg(F.sort_array(F.collect_set("area")).alias("areas"))
    d = points.join(inside, row_id, "left")
    outside = d.where(F.col("areas").isNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(row_id, x, y)
    near = nearest(outside, areas, row_id, x, y, size).select(row_id, F.array("area").alias("_near"))
    d = d.join(near, row_id, "left")
    kind = F.when(F.size("areas") == 1, "IN").when(F.size("areas") > 1, "BORDER").when(F.col("_near").isNotNull(), "NEAREST")
    return d.withColumn("kind", kind).withColumn("areas", F.coalesce("areas", "_near")).drop("_near")


def settled(points: DataFrame, areas: DataFrame, adjacent: DataFrame, row_id: str, x: str, y: str, street: str, number: str, suburb: str, share: float = 0.6, support: int = 3, size: float = 0.05) -> DataFrame:
    """One area for each row in five passes (K6): among areas named after its suburb, among those of adjacent suburbs
    (``suburb``, ``beside``), among all; then the nearest number of the same street; then the street's dominant area. A row
    between several areas that nothing settles gets their names joined. Areas have ``name``, ``ring`` and ``suburb``."""
    inside = containing(points.select(row_id, x, y, suburb), areas.select("name", "ring"), x, y, size).select(row_id, F.col(suburb).alias("_s"), "area").distinct()
    named = inside.join(areas.select(F.col("name").alias("area"), F.col("suburb").alias("_of")).distinct(), "area")
    beside = named.join(adjacent.select(F.col("suburb").alias("_s"), F.col("beside").alias("_of")).distinct().withColumn("_beside", F.lit(True)), ["_s", "_of"], "left")
    tier = F.when(F.lower("_s") == F.lower("_of"), 1).when(F.col("_beside"), 2).otherwise(3)
    first = rank.first_by(beside.withColumn("pass", tier).groupBy(row_id, "pass").agg(F.sort_array(F.collect_set("area")).alias("areas")), [row_id], ["pass"])
    d = points.join(first, row_id, "left")
    one = F.when(F.size("areas") == 1, F.get("areas", F.lit(0)))
    d = d.withColumns({"area": one, "kind": F.when(F.size("areas") == 1, "IN").when(F.size("areas") > 1, "BORDER")})
    outside = d.where(F.col("areas").isNull() & F.col(x).isNotNull()).select(row_id, x, y)
    near = nearest(outside, areas.select("name", "ring"), row_id, x, y, size).select(row_id, F.col("area").alias("_near"))
    d = d.join(near, row_id, "left").withColumns({"area": F.coalesce("area", "_near"), "kind": F.coalesce("kind", F.when(F.col("_near").isNotNull(), "NEAREST"))}).drop("_near")
    before = d.withColumn("_was", F.col("area"))
    d = nearest_number(before, row_id, street, number, "area").withColumn("kind", F.when(F.col("_was").isNull() & F.col("area").isNotNull(), "NUMBER").otherwise(F.col("kind"))).drop("_was")
    d = pulled(d, [street], "area", row_id, F.coalesce(F.col("kind") == "IN", F.lit(False)), share, support)
    return d.withColumn("area", F.coalesce("area", F.array_join("areas", "_"))).drop("areas", "pass")


def by_cells(left: DataFrame, right: DataFrame, on: Sequence[str], size: float) -> DataFrame:
    """Pairs of rows whose bounds (``west``…``north``) overlap (C18, the range join before an intersection)."""
    span = lambda d, lo, hi: F.explode(F.sequence(_cell(F.col(lo), size), _cell(F.col(hi), size)))
    spread = lambda d: d.withColumn("_cx", span(d, "west", "east")).withColumn("_cy", span(d, "south", "north"))
    b = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    b = b.withColumn("_cx", span(b, "r_west", "r_east")).withColumn("_cy", span(b, "r_south", "r_north"))
    pairs = spread(left).join(b, ["_cx", "_cy"]).where("west <= r_east and r_west <= east and south <= r_north and r_south <= north")
    # A pair that shares several cells counts in the first of them only.
    first = (F.greatest(_cell(F.col("west"), size), _cell(F.col("r_west"), size)) == F.col("_cx")) & (F.greatest(_cell(F.col("south"), size), _cell(F.col("r_south"), size)) == F.col("_cy"))
    return pairs.where(first).drop("_cx", "_cy")


def middle_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The middle row of each key, as a label's place."""
    w = Window.partitionBy(key)
    d = df.withColumns({"_nth": F.row_number().over(w.orderBy(order)), "_n": F.count(F.lit(1)).over(w)})
    return d.where(F.col("_nth") == F.ceil(F.col("_n") / 2)).drop("_nth", "_n")
