"""Building the gazetteer: streets, crossings, anchors, and their cleaning.

Distance joins go through grid cells (an equi-join on cells, then the exact test); range joins
through number buckets. No step compares all pairs of a district.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text as T
from ..sources.shared import stored

JOIN_M, ATTACH_M, NEAR_M, NEAR_FACTOR, NEAR_EXTRA_M = 30, 120, 40, 2, 15
CELL = 0.001
SKIPPED_KINDS = ("motorway", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "service", "footway", "path", "cycleway", "steps", "track")


def cells(lng, lat, reach: int = 0, size: float = CELL):
    """The cell of a point, or with its neighbours up to ``reach`` cells away."""
    x, y = F.floor(lng / size), F.floor(lat / size)
    around = lambda c: F.sequence(c - reach, c + reach)
    return F.flatten(F.transform(around(x), lambda i: F.transform(around(y), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def reached(lng, lat, reach: float, size: float, room: float = 0.0):
    """The cells of side ``size`` that hold a place within ``reach`` metres of a point, and ``room`` degrees around them."""
    up = reach * 1.01 / geo.DEGREE_M
    span = lambda v, d: F.sequence(F.floor((v - d - room) / size), F.floor((v + d + room) / size))
    return F.flatten(F.transform(span(lng, up / F.cos(F.radians(lat))), lambda i: F.transform(span(lat, F.lit(up)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def named_ways(ways: DataFrame) -> DataFrame:
    """Ways of two points or more that have a name and are streets."""
    return ways.where((F.coalesce(F.col("tags")["name"], F.lit("")) != "") & ~F.col("tags")["highway"].isin(*SKIPPED_KINDS) & (F.size("points") >= 2))


def grouped_streets(ways: DataFrame) -> DataFrame:
    """ubigeo, type, key: lines, refs and aliases of the ways of one name in a district."""
    keyed = ways.withColumn("key", T.key(F.col("name")))
    return keyed.groupBy("ubigeo", "type", "key").agg(F.collect_list("points").alias("lines"), F.sort_array(F.collect_set("ref")).alias("refs"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases"))


def free_aliases(streets: DataFrame) -> DataFrame:
    """street_id, ubigeo, alias: aliases that are no street's own name in the district, from (street_id, ubigeo, key, aliases)."""
    a = streets.select("street_id", "ubigeo", F.explode("aliases").alias("name")).select("street_id", "ubigeo", T.key(F.col("name")).alias("alias")).distinct()
    return a.join(streets.select("ubigeo", F.col("key").alias("alias")), ["ubigeo", "alias"], "left_anti").select("street_id", "ubigeo", "alias")


def linked(lines: DataFrame, reach: float = JOIN_M, cell: float = CELL) -> DataFrame:
    """a, b (cells must be at least ``reach`` wide): lines of one group with an end of one within ``reach`` metres of the other; from (grp, line_id, lng0, lat0, lng1, lat1)."""
    ends = lines.select("grp", "line_id", F.explode(F.array(F.struct(F.col("lng0").alias("lng"), F.col("lat0").alias("lat")), F.struct(F.col("lng1").alias("lng"), F.col("lat1").alias("lat")))).alias("e")).select("grp", F.col("line_id").alias("a"), F.col("e.lng").alias("lng"), F.col("e.lat").alias("lat"))
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lng1") - F.col("lng0")), F.abs(F.col("lat1") - F.col("lat0"))) / cell)).cast("int")
    along = F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct(F.floor((F.col("lng0") + (F.col("lng1") - F.col("lng0")) * i / steps) / cell).alias("cx"), F.floor((F.col("lat0") + (F.col("lat1") - F.col("lat0")) * i / steps) / cell).alias("cy")))
    placed = lines.select("grp", F.col("line_id").alias("b"), "lng0", "lat0", "lng1", "lat1", F.explode(F.array_distinct(along)).alias("c"))
    near = ends.withColumn("c", F.explode(cells(F.col("lng"), F.col("lat"), 1, cell)))
    hit = near.join(placed, ["grp", "c"]).where((F.col("a") != F.col("b")) & (geo.segment_distance(F.col("lng"), F.col("lat"), F.col("lng0"), F.col("lat0"), F.col("lng1"), F.col("lat1")) <= reach))
    return hit.select("a", "b").distinct()


def street_components(lines: DataFrame, reach: float = JOIN_M, cell: float = CELL) -> DataFrame:
    """line_id, street: the least line of its component. Labels fall round by round, with jumps to the label's own label."""
    both = linked(lines, reach, cell)
    both = stored(both.union(both.select("b", "a")).distinct(), "street-links")
    labels = lines.select(F.col("line_id").alias("node"), F.col("line_id").alias("label"))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        near = labels.join(around, labels["node"] == around["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("least", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = near.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        after = stored(after, "street-labels")
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels.select(F.col("node").alias("line_id"), F.col("label").alias("street"))


def crossings(vertices: DataFrame) -> DataFrame:
    """street_id, lng, lat: vertices shared, exactly, with a street of another key; from (street_id, key, lng, lat)."""
    at = vertices.select("street_id", "key", "lng", "lat").distinct()
    shared = at.groupBy("lng", "lat").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("lng", "lat")
    return at.join(shared, ["lng", "lat"]).select("street_id", "lng", "lat").distinct()


def attach(points: DataFrame, streets: DataFrame, reach: float = ATTACH_M) -> DataFrame:
    """point_id, street_id, metres: the nearest street of the point's district, type and key, or where none has that type of its key alone, within ``reach``.

    Points meet the streets of their key in the cells that hold all places within ``reach``; distances
    are compared to the micrometre, then by street.
    """
    size = 2 * reach / geo.DEGREE_M
    s = streets.select("street_id", "ubigeo", "key", F.col("type").alias("s_type"), "lng0", "lat0", "lng1", "lat1")
    own = s.select("ubigeo", "key", F.col("s_type").alias("type")).distinct().withColumn("own", F.lit(True))
    # A street stands in the cells of places at most half a cell apart, so each of its places is within a quarter of one of them.
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lng1") - F.col("lng0")), F.abs(F.col("lat1") - F.col("lat0"))) / (size / 2))).cast("int")
    along = F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct(F.floor((F.col("lng0") + (F.col("lng1") - F.col("lng0")) * i / steps) / size).alias("cx"), F.floor((F.col("lat0") + (F.col("lat1") - F.col("lat0")) * i / steps) / size).alias("cy")))
    placed = s.withColumn("c", F.explode(F.array_distinct(along)))
    p = points.select("point_id", "ubigeo", "key", "type", "lng", "lat").join(own, ["ubigeo", "key", "type"], "left")
    near = p.withColumn("c", F.explode(reached(F.col("lng"), F.col("lat"), reach, size, size / 4)))
    d = geo.segment_distance(F.col("lng"), F.col("lat"), F.col("lng0"), F.col("lat0"), F.col("lng1"), F.col("lat1"))
    hit = near.join(placed, ["ubigeo", "key", "c"]).where(F.col("own").isNull() | (F.col("type") == F.col("s_type"))).withColumn("metres", d)
    best = hit.groupBy("point_id").agg(F.min(F.struct(F.round("metres", 6).alias("r"), "street_id", "metres")).alias("r"))
    return best.select("point_id", "r.street_id", "r.metres").where(F.col("metres") <= reach)


def nearest_clear(points: DataFrame, streets: DataFrame) -> DataFrame:
    """point_id, key, metres: the nearest street name, where it is near and clearly nearer than any other name."""
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lng1") - F.col("lng0")), F.abs(F.col("lat1") - F.col("lat0"))) / (CELL / 2))).cast("int")
    along = F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct(F.floor((F.col("lng0") + (F.col("lng1") - F.col("lng0")) * i / steps) / CELL).alias("cx"), F.floor((F.col("lat0") + (F.col("lat1") - F.col("lat0")) * i / steps) / CELL).alias("cy")))
    placed = streets.select("key", "lng0", "lat0", "lng1", "lat1", F.explode(F.array_distinct(along)).alias("c"))
    near = points.withColumn("c", F.explode(cells(F.col("lng"), F.col("lat"), 1))).join(placed, "c")
    d = geo.segment_distance(F.col("lng"), F.col("lat"), F.col("lng0"), F.col("lat0"), F.col("lng1"), F.col("lat1"))
    names = near.groupBy("point_id", "key").agg(F.min(d).alias("metres"))
    two = names.groupBy("point_id").agg(F.min_by("key", F.struct("metres", "key")).alias("key"), F.sort_array(F.collect_list("metres")).alias("all"))
    d1, d2 = F.col("all")[0], F.get("all", F.lit(1))
    return two.where((d1 <= NEAR_M) & (d2.isNull() | (d2 >= NEAR_FACTOR * d1 + NEAR_EXTRA_M))).select("point_id", "key", d1.alias("metres"))


def consistent(anchors: DataFrame) -> DataFrame:
    """Anchors without those that have, on their street and side, one at most 20 numbers off and over 150 m away; from (anchor_id, street_id, number, lng, lat)."""
    a = anchors.select("anchor_id", "street_id", (F.col("number") % 2).alias("side"), "number", "lng", "lat").withColumn("bucket", F.floor(F.col("number") / 20))
    b = a.select("street_id", "side", F.col("anchor_id").alias("o_id"), F.col("number").alias("o_number"), F.col("lng").alias("o_lng"), F.col("lat").alias("o_lat"), F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket"))
    bad = a.join(b, ["street_id", "side", "bucket"]).where((F.col("anchor_id") != F.col("o_id")) & (F.abs(F.col("number") - F.col("o_number")) <= 20) & (geo.distance(F.col("lng"), F.col("lat"), F.col("o_lng"), F.col("o_lat")) > 150))
    return anchors.join(bad.select("anchor_id").distinct(), "anchor_id", "left_anti")


def first_areas(areas: DataFrame) -> DataFrame:
    """One area per district and key: the first by id."""
    w = Window.partitionBy("ubigeo", "key").orderBy("area_id")
    return areas.withColumn("key", T.area_key(F.col("name"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_verified(observations: DataFrame) -> DataFrame:
    """The observation that holds for each address: an operator's pin before GPS, then the newest; gold only."""
    w = Window.partitionBy("address_hash").orderBy((F.col("method") == "OPERATOR_PIN").desc(), F.desc("created_at"), F.desc("obs_id"))
    return observations.where("quality = 'oro'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def promoted_aliases(candidates: DataFrame, names: DataFrame, least: int = 2) -> DataFrame:
    """ubigeo, alias, street_id: confirmed by ``least`` operators, for one street only, and no street's own name in the district."""
    votes = candidates.groupBy("ubigeo", "alias", "street_id").agg(F.count_distinct("operator").alias("n"))
    strong = votes.where(F.col("n") >= least)
    rival = candidates.groupBy("ubigeo", "alias").agg(F.count_distinct("street_id").alias("s")).where("s > 1")
    own = names.select("ubigeo", F.col("key").alias("alias"))
    return strong.join(rival, ["ubigeo", "alias"], "left_anti").join(own, ["ubigeo", "alias"], "left_anti").select("ubigeo", "alias", "street_id")


def overlay(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Live edits over a base of (street_id, number, lng, lat, ref): an edited number replaces the base's."""
    live = edits.where("deleted_at IS NULL").select("street_id", "number", "lng", "lat", "ref")
    return base.join(live.select("street_id", "number").distinct(), ["street_id", "number"], "left_anti").select("street_id", "number", "lng", "lat", "ref").unionByName(live)


def edit_counts(streets: DataFrame, edits: DataFrame) -> DataFrame:
    """kind, applied, orphans: live edits (kind, street_id, deleted_at) whose street a new build still has, and those it no longer has."""
    known = streets.select("street_id", F.lit(True).alias("known")).distinct()
    d = edits.where("deleted_at IS NULL").join(known, "street_id", "left")
    return d.groupBy("kind").agg(F.count_if("known").alias("applied"), F.count_if(F.col("known").isNull()).alias("orphans"))
