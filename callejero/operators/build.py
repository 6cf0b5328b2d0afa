"""The build chain of a gazetteer: from map extracts and hand-made edits to streets with stable ids and anchors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import geo, text as T
from ..sources.shared import stored
from . import gazetteer as gaz, normalize as norm

ID_BITS = 30
#: Hashes are summed up in so many ranges (a power of two).
PART_BITS = 10
LEAST_BLOCK_M = 25
#: What an extract takes from the map. Kinds of places that are areas.
AREA_PLACES = ("neighbourhood", "suburb", "quarter", "hamlet")


def extract_kind(tags: Column) -> Column:
    """What a map element with these tags is for the gazetteer: district, address, house_number, area, street, or null."""
    has = lambda name: F.coalesce(tags[name], F.lit("")) != ""
    district = (tags["admin_level"] == "8") & (tags["boundary"] == "administrative") & has("pe:ubigeo")
    area = has("name") & (tags["place"].isin(*AREA_PLACES) | (tags["landuse"] == "residential"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(district), "district").when(has("addr:street") & has("addr:housenumber"), "address").when(has("addr:housenumber"), "house_number")
        .when(yes(area), "area").when(has("highway") & has("name"), "street")
    )


def read_names(rows: DataFrame, name: Column, entries: list[dict]) -> DataFrame:
    """``rows`` with ``type`` and ``display`` of a street's name, which the normalizer reads; names that hold a number or a block are left out.

    Distinct names are read once.
    """
    asked = rows.withColumn("_name", F.coalesce(name, F.lit("")))
    read = norm.normalize(asked.select(F.col("_name").alias("address")).distinct(), entries)
    sound = read.where("street_name <> '' AND number = '' AND block = ''").select(F.col("address").alias("_name"), F.col("street_type").alias("type"), F.col("street_name").alias("display"))
    return asked.join(sound, "_name").drop("_name")


def way_districts(ways: DataFrame, edges: DataFrame, ident: str = "way_id") -> DataFrame:
    """way_id, ubigeo: the one district in which a way's middle vertex lies; ways in none or several are left out."""
    middle = F.get("points", F.floor(F.size("points") / 2).cast("int"))
    return geo.only_district(ways.select(ident, middle["lng"].alias("lng"), middle["lat"].alias("lat")), edges, ident)


def with_drawn(ways: DataFrame, drawn: DataFrame) -> DataFrame:
    """Ways (ref, ubigeo, type, name, aliases, points) and the live drawn streets (drawn_id, ubigeo, type, name, points, deleted_at), which group with ways of their name."""
    live = drawn.where(F.col("deleted_at").isNull() & (F.size("points") >= 2))
    lines = live.select(F.concat(F.lit("m"), F.col("drawn_id").cast("string")).alias("ref"), "ubigeo", "type", "name", F.array().cast("array<string>").alias("aliases"), "points")
    return ways.select("ref", "ubigeo", "type", "name", "aliases", "points").unionByName(lines)


def stable_ids(streets: DataFrame, bits: int = ID_BITS) -> DataFrame:
    """``streets`` with ``street_id``: the upper bits of a hash of district, type, key and oldest way, the same on every build.

    Streets (pos, ubigeo, type, key, refs) take, in order of ``pos`` (null last), the first number from their hash on
    that is free. A hash of 0 counts as 1. Streets of one hash count on from it, unless their
    numbers reach the next hash: such runs of hashes are found by sums over ranges of hashes,
    and only within them are streets taken one after another. A street is known by its hash and its place
    among that hash's streets: ``pos`` may occur twice or be null.
    """
    oldest = F.expr("array_sort(refs, (a, b) -> CASE WHEN length(a) <> length(b) THEN length(a) - length(b) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)[0]")
    hi, _ = T.fnv1a(F.concat_ws("|", "ubigeo", "type", "key", oldest))
    alike = Window.partitionBy("_id").orderBy(F.asc_nulls_last("pos"))
    asked = streets.withColumn("_id", F.greatest(F.lit(1), F.shiftright(hi, 32 - bits)).cast("long"))
    asked = stored(asked.withColumn("_nth", F.row_number().over(alike)), "street-ids")

    # With ``n`` streets before a hash, its run's numbers end where the greatest (hash - n) so far says; a greater one begins a run.
    inside = Window.partitionBy("part").orderBy("_id")
    g = asked.groupBy("_id").agg(F.count("*").alias("n")).withColumn("part", F.shiftright("_id", max(0, bits - PART_BITS)))
    g = g.withColumn("start", F.col("_id") - (F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")))
    g = stored(g.withColumn("top", F.max("start").over(inside.rowsBetween(Window.unboundedPreceding, 0))), "street-hashes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = g.groupBy("part").agg(F.sum("n").alias("n"), F.max("start").alias("start")).withColumn("less", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.select("part", "less", F.max(F.col("start") - F.col("less")).over(before).alias("above"))
    runs = g.join(parts, "part").select("_id", F.greatest(F.col("top") - F.col("less"), "above").alias("run"))
    mixed = runs.groupBy("run").agg(F.count("*").alias("hashes")).where("hashes > 1").select("run")

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pos", "ascending"), ("_nth", "ascending")])
        free: dict[int, int] = {}  # a taken number leads to one that may be free
        out = []
        for want in table.column("_id").to_pylist():
            passed, at = [], want
            while at in free:
                passed.append(at)
                at = free[at]
            out.append(at)
            free |= dict.fromkeys((*passed, at), at + 1)
        return table.select(["_id", "_nth"]).append_column("street_id", pa.array(out, pa.int64()))

    schema = StructType([asked.schema["_id"], asked.schema["_nth"], StructField("street_id", LongType())])
    among = asked.select("pos", "_id", "_nth").join(runs.join(mixed, "run"), "_id").groupBy("run").applyInArrow(settle, schema)
    number = F.coalesce("street_id", F.col("_id") + F.col("_nth") - 1)
    return asked.join(among, ["_id", "_nth"], "left").withColumn("street_id", number).drop("_id", "_nth")


def held_points(golden: DataFrame, split: str = "test") -> DataFrame:
    """osm_id: map points that stand behind golden rows of a split (or of ``all``), from (id, split); these never become anchors."""
    of = golden if split == "all" else golden.where(F.col("split") == split)
    bare = F.regexp_replace(F.regexp_replace("id", "^OSM-", ""), "^SYN-", "")
    variant = F.col("id").startswith("SYN-") & (F.instr(bare, "-") > 1)
    return of.select(F.when(variant, F.regexp_replace(bare, "-[^-]*$", "")).otherwise(bare).alias("osm_id")).distinct()


def house_numbers(points: DataFrame, streets: DataFrame) -> DataFrame:
    """point_id, number, key, reason: points with a number but no street, given to a street that is clearly nearest.

    ``points`` is (point_id, house_number, plot, lng, lat). The reason is ok, es_lote (a lot's number
    is no door's), numero_no_simple or sin_calle_clara; number and key are null unless it is ok.
    """
    number = T.anchor_number(F.col("house_number"))
    plot = F.coalesce(F.col("plot"), F.lit("")) != ""
    usable = points.where(~plot & number.isNotNull()).select("point_id", "lng", "lat")
    near = gaz.nearest_clear(usable, streets).select("point_id", "key")
    d = points.select("point_id", number.alias("number"), plot.alias("plot")).join(near, "point_id", "left")
    reason = F.when(F.col("plot"), "es_lote").when(F.col("number").isNull(), "numero_no_simple").when(F.col("key").isNull(), "sin_calle_clara").otherwise("ok")
    return d.select("point_id", F.when(reason == "ok", F.col("number")).alias("number"), F.when(reason == "ok", F.col("key")).alias("key"), reason.alias("reason"))


def nearest_precision(points: DataFrame, streets: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: tried and right, for the nearest-street rule on points whose street is known (point_id, own_key, lng, lat); an alias (key, alias) counts as right."""
    near = gaz.nearest_clear(points.select("point_id", "lng", "lat"), streets).select("point_id", "key")
    d = points.select("point_id", "own_key").where("own_key <> ''").join(near, "point_id")
    known = aliases.select("key", F.col("alias").alias("own_key"), F.lit(True).alias("by_alias")).distinct()
    d = d.join(known, ["key", "own_key"], "left")
    return d.agg(F.count("*").alias("tried"), F.count_if((F.col("key") == F.col("own_key")) | F.coalesce("by_alias", F.lit(False))).alias("right"))


def labelled_anchors(points: DataFrame, streets: DataFrame, held: DataFrame) -> DataFrame:
    """point_id, street_id, number, reason of labelled points (point_id, osm_id, house_number, ubigeo, key, type, lng, lat).

    The first reason counts: excluido_test (in ``held``), numero_no_simple, sin_distrito (null
    ubigeo), calle_no_parseable (empty key), sin_calle, lejos_de_su_calle, ok.
    """
    number = T.anchor_number(F.col("house_number"))
    d = points.join(held.select("osm_id").distinct().withColumn("held", F.lit(True)), "osm_id", "left")
    usable = d.where(F.col("held").isNull() & number.isNotNull() & F.col("ubigeo").isNotNull() & (F.col("key") != ""))
    best = gaz.attach(usable.select("point_id", "ubigeo", "key", "type", "lng", "lat"), streets)
    named = streets.select("ubigeo", "key").distinct().withColumn("named", F.lit(True))
    d = d.select("point_id", number.alias("number"), "held", "ubigeo", "key").join(best, "point_id", "left").join(named, ["ubigeo", "key"], "left")
    reason = (
        F.when(F.col("held"), "excluido_test").when(F.col("number").isNull(), "numero_no_simple").when(F.col("ubigeo").isNull(), "sin_distrito").when(F.col("key") == "", "calle_no_parseable")
        .when(F.col("named").isNull(), "sin_calle").when(F.col("street_id").isNull(), "lejos_de_su_calle").otherwise("ok")
    )
    ok = reason == "ok"
    return d.select("point_id", F.when(ok, F.col("street_id")).alias("street_id"), F.when(ok, F.col("number")).alias("number"), reason.alias("reason"))


def sorted_anchors(anchors: DataFrame) -> DataFrame:
    """street_id, anchors: each street's anchors in order of number, then place and id."""
    return anchors.groupBy("street_id").agg(F.sort_array(F.collect_list(F.struct("number", "lng", "lat", "anchor_id"))).alias("anchors"))


def bare_blocks(extents: DataFrame, cuts: DataFrame) -> DataFrame:
    """street_id, block, lo, hi: a street's blocks between its crossings, without numbers, for drawing.

    ``extents`` is (street_id, lo, hi), ``cuts`` (street_id, cut). A cut nearer than LEAST_BLOCK_M to the
    one before is dropped, and the last block ends where the street does. Streets without extent have none.
    """
    gathered = cuts.groupBy("street_id").agg(F.sort_array(F.collect_list(F.col("cut").cast("double"))).alias("cuts"))
    d = extents.where("hi > lo").join(gathered, "street_id", "left")
    none = F.array().cast("array<double>")
    kept = F.aggregate(F.coalesce("cuts", none), F.array(F.col("lo").cast("double")), lambda b, c: F.when(c - F.element_at(b, -1) >= LEAST_BLOCK_M, F.concat(b, F.array(c))).otherwise(b))
    d = d.select("street_id", "hi", kept.alias("b"))
    short = (F.size("b") > 1) & (F.col("hi") - F.element_at("b", -1) < LEAST_BLOCK_M)
    bounds = F.concat(F.when(short, F.slice("b", F.lit(1), F.size("b") - 1)).otherwise(F.col("b")), F.array(F.col("hi").cast("double")))
    d = d.select("street_id", bounds.alias("b"))
    return d.select("street_id", F.posexplode(F.expr("transform(sequence(0, size(b) - 2), i -> struct(b[i] AS lo, b[i + 1] AS hi))")).alias("block", "s")).select("street_id", "block", "s.lo", "s.hi")


def district_polygons(relations: DataFrame, catalog: DataFrame, tolerance: float) -> DataFrame:
    """ubigeo, name, ring, points, renamed: the outlines of districts from map relations (ubigeo, name, members).

    Members that are ways in the role outer, inner or none are chained into rings, simplified
    and rounded to six digits; one relation is worked on at a time. ``renamed`` tells that the
    map's name is not the catalog's (code, district). Raises on codes that the catalog lacks, and on rings that do not close.
    """
    known = catalog.select(F.col("code").alias("ubigeo"), T.key(F.col("district")).alias("_key"))
    d = relations.join(known, "ubigeo", "left")
    lines = F.transform(F.filter("members", lambda m: (m["type"] == "way") & F.coalesce(m["role"], F.lit("")).isin("outer", "inner", "")), lambda m: F.transform(m["geometry"], lambda p: F.array(p["lon"], p["lat"])))
    d = d.select("ubigeo", "name", lines.alias("lines"), F.col("_key").isNull().alias("unknown"), (T.key(F.col("name")) != F.col("_key")).alias("renamed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["unknown"]:
                    raise ValueError(f"code {r['ubigeo']!r} is not in the catalog")
                rings = geo.assemble_rings([[tuple(p) for p in line] for line in r["lines"]])
                for i, ring in enumerate(geo.simplify(ring, tolerance) for ring in rings):
                    points = [{"lng": round(x, 6), "lat": round(y, 6)} for x, y in ring]
                    out.append({"ubigeo": r["ubigeo"], "name": r["name"], "ring": i, "points": points, "renamed": r["renamed"]})
            point = pa.struct([("lng", pa.float64()), ("lat", pa.float64())])
            schema = pa.schema([("ubigeo", pa.string()), ("name", pa.string()), ("ring", pa.int32()), ("points", pa.list_(point)), ("renamed", pa.bool_())])
            yield pa.RecordBatch.from_pylist(out, schema)

    return d.mapInArrow(run, "ubigeo string, name string, ring int, points array<struct<lng: double, lat: double>>, renamed boolean")
