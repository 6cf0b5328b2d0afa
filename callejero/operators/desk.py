"""The review desk: pins, hand-made edits and resolutions as append-only events, and reloads as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text as T
from . import locate as loc

PIN_FAR_M, EDIT_FAR_M = 100, 60
MAX_HUNDRED, MAX_NUMBER = 999, 99_999


def _with_metres(points: DataFrame, segments: DataFrame) -> DataFrame:
    """``points`` with metres to the point's own street; null where the street is unknown. Points are not shuffled by their id."""
    columns = points.columns
    return geo.with_nearest(points.join(loc.gathered(segments), "street_id", "left")).select(*columns, F.col("n.metres").alias("metres"))


def pin_alerts(pins: DataFrame, edges: DataFrame, segments: DataFrame) -> DataFrame:
    """pin_id, alerts: PIN_OUTSIDE_DISTRICT, PIN_FAR_FROM_STREET; from (pin_id, ubigeo, street_id, lng, lat).

    A district without polygon raises no alert; a street without geometry counts as far; a pin
    without street is not held against one.
    """
    inside = geo.locate(pins.select("pin_id", "lng", "lat"), edges, "pin_id").withColumn("inside", F.lit(True))
    drawn = edges.select("ubigeo").distinct().withColumn("drawn", F.lit(True))
    d = _with_metres(pins, segments).join(inside, ["pin_id", "ubigeo"], "left").join(drawn, "ubigeo", "left")
    outside = F.col("drawn") & F.col("inside").isNull()
    far = F.col("street_id").isNotNull() & (F.coalesce("metres", F.lit(1e9)) > PIN_FAR_M)
    return d.select("pin_id", F.array_compact(F.array(F.when(outside, "PIN_OUTSIDE_DISTRICT"), F.when(far, "PIN_FAR_FROM_STREET"))).alias("alerts"))


def edit_errors(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """edit_id, error ('' if none) of (edit_id, kind: mark or anchor, street_id, value, lng, lat)."""
    d = _with_metres(edits, segments)
    sound = F.when(F.col("kind") == "mark", F.col("value").between(0, MAX_HUNDRED)).otherwise(F.col("value").between(1, MAX_NUMBER))
    error = F.when(~F.coalesce(sound, F.lit(False)), "VALUE_OUT_OF_RANGE").when(F.col("metres").isNull(), "UNKNOWN_STREET").when(F.col("metres") > EDIT_FAR_M, "FAR_FROM_STREET").otherwise("")
    return d.select("edit_id", error.alias("error"))


def drawn_street_error(ubigeo_touched: Column, name: Column, n_points: Column) -> Column:
    return F.when(n_points < 2, "TOO_FEW_POINTS").when(F.trim(F.coalesce(name, F.lit(""))) == "", "NO_NAME").when(~F.coalesce(ubigeo_touched, F.lit(False)), "OUTSIDE_DISTRICT").otherwise("")


def street_edits(manual: DataFrame, pins: DataFrame) -> DataFrame:
    """street_id, number, lng, lat, ref: live hand-made numbers, and pins whose number no hand-made one overrides."""
    live = manual.where("deleted_at IS NULL").select("street_id", "number", "lng", "lat", F.concat(F.lit("manual:"), F.col("edit_id").cast("string")).alias("ref"))
    rest = pins.join(live.select("street_id", "number").distinct(), ["street_id", "number"], "left_anti")
    return live.unionByName(rest.select("street_id", "number", "lng", "lat", F.concat(F.lit("pin:"), F.col("pin_id").cast("string")).alias("ref")))


def drawn_streets(drawn: DataFrame, ubigeo: str) -> DataFrame:
    """The live drawn streets of a district, in order of their id."""
    return drawn.where((F.col("ubigeo") == ubigeo) & F.col("deleted_at").isNull()).orderBy("drawn_id")


def soft_deleted(edits: DataFrame, deletions: DataFrame) -> DataFrame:
    """``edits`` with deleted_at: the first time of each in ``deletions`` (edit_id, at); later deletions change nothing."""
    first = deletions.groupBy("edit_id").agg(F.min("at").alias("deleted_at"))
    return edits.drop("deleted_at").join(first, "edit_id", "left")


def judged_actions(actions: DataFrame, tickets: DataFrame) -> DataFrame:
    """Each action with ``error`` ('' if accepted) and the status it leads to.

    Actions (ticket_id, action_id, at, actor, action, lng, lat, street_id, note) are judged in order of
    time and id: a pin needs a point, unresolvable needs a note, and nothing follows the action
    that closed a ticket. ``tickets`` is (ticket_id, status).
    """
    wanted = (
        F.when(~F.col("action").isin("pin", "unresolvable", "escalate"), "UNKNOWN_ACTION").when((F.col("action") == "pin") & (F.col("lng").isNull() | F.col("lat").isNull()), "PIN_WITHOUT_POINT")
        .when((F.col("action") == "unresolvable") & (F.coalesce("note", F.lit("")) == ""), "NO_REASON").otherwise("")
    )
    d = actions.join(tickets.select("ticket_id", "status"), "ticket_id").withColumn("error", wanted)
    closes = (F.col("error") == "") & F.col("action").isin("pin", "unresolvable")
    before = Window.partitionBy("ticket_id").orderBy("at", "action_id").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.col("status").isin("resolved", "unresolvable") | F.coalesce(F.max(closes).over(before), F.lit(False))
    d = d.withColumn("_closed", closed).withColumn("error", F.when(F.col("_closed"), "CLOSED").otherwise(F.col("error")))
    new = F.when(F.col("error") != "", None).when(F.col("action") == "pin", "resolved").when(F.col("action") == "unresolvable", "unresolvable").otherwise("escalated")
    return d.withColumn("new_status", new).drop("_closed", "status")


def observations(judged: DataFrame, tickets: DataFrame) -> DataFrame:
    """The gold observation of each accepted pin, by the address's hash; ``tickets`` adds address_key."""
    d = judged.where("error = '' AND action = 'pin'").join(tickets.select("ticket_id", "address_key"), "ticket_id")
    return d.select(F.sha2("address_key", 256).alias("address_hash"), "lng", "lat", F.lit("OPERATOR_PIN").alias("method"), F.lit("oro").alias("quality"), F.col("actor").alias("author"), F.concat(F.lit("ticket:"), F.col("ticket_id").cast("string")).alias("source_ref"), F.col("at").alias("created_at"))


def alias_candidates(judged: DataFrame, tickets: DataFrame, streets: DataFrame) -> DataFrame:
    """ubigeo, alias, street_id, operator of accepted pins whose written street name is not the chosen street's own; ``tickets`` adds street_name."""
    d = judged.where("error = '' AND action = 'pin'").join(tickets.select("ticket_id", T.key(F.col("street_name")).alias("alias")), "ticket_id")
    return d.join(streets.select("street_id", "ubigeo", "key"), "street_id").where("alias <> '' AND alias <> key").select("ubigeo", "alias", "street_id", F.col("actor").alias("operator"))


def audit_trail(judged: DataFrame, tickets: DataFrame) -> DataFrame:
    """ticket_id, action_id, actor, action, before, after: the status each accepted action found and left."""
    w = Window.partitionBy("ticket_id").orderBy("at", "action_id")
    d = judged.where("error = ''").join(tickets.select("ticket_id", "status"), "ticket_id")
    return d.select("ticket_id", "action_id", "actor", "action", F.coalesce(F.lag("new_status").over(w), F.col("status")).alias("before"), F.col("new_status").alias("after"))


def ticket_details(tickets: DataFrame, districts: DataFrame, streets: DataFrame, lines: DataFrame) -> DataFrame:
    """Tickets with their district's name and polygon, and their candidate streets as a GeoJSON FeatureCollection.

    ``candidates`` is JSON text; malformed or null text means no candidates. ``districts`` is
    (ubigeo, district, polygon), ``lines`` (street_id, lines: array of arrays of (lng, lat)).
    """
    ids = F.from_json("candidates", "candidates array<struct<street_id: bigint>>")["candidates"]["street_id"]
    asked = tickets.select("ticket_id", F.explode(F.array_distinct(ids)).alias("street_id"))
    pairs = F.transform("lines", lambda l: F.transform(l, lambda p: F.array(F.round(p["lng"], 6), F.round(p["lat"], 6))))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct("street_id", F.trim(F.concat_ws(" ", "type", "name")).alias("name")).alias("properties"),
        F.struct(F.lit("MultiLineString").alias("type"), pairs.alias("coordinates")).alias("geometry"),
    )
    found = asked.join(streets.select("street_id", "type", "name"), "street_id").join(lines, "street_id").select("ticket_id", "street_id", feature.alias("f"))
    g = found.groupBy("ticket_id").agg(F.sort_array(F.collect_list(F.struct("street_id", "f"))).alias("fs"))
    d = tickets.join(districts, "ubigeo", "left").join(g, "ticket_id", "left")
    features = F.when(F.col("fs").isNull(), F.lit('{"type":"FeatureCollection","features":[]}')).otherwise(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("fs.f").alias("features"))))
    return d.select(*tickets.columns, F.coalesce("district", F.lit("")).alias("district"), "polygon", F.coalesce(F.size("fs"), F.lit(0)).alias("n_streets"), features.alias("streets_geojson"))


def loaded_districts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Districts after a load: new rows win, an absent polygon keeps the old one; from (ubigeo, district, polygon)."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.ubigeo") == F.col("n.ubigeo"), "full_outer")
    return j.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("ubigeo", "district", "polygon")])


def reloaded_streets(old: DataFrame, new: DataFrame, references: DataFrame) -> DataFrame:
    """Streets after a reload: all new ones, and old ones that are gone but still referenced (street_id)."""
    kept = old.join(new.select("street_id"), "street_id", "left_anti").join(references.select("street_id").where("street_id IS NOT NULL").distinct(), "street_id", "left_semi")
    return new.withColumn("state", F.lit("live")).unionByName(kept.withColumn("state", F.lit("referenced")))


def same_version(streets: DataFrame, loaded: str) -> DataFrame:
    """One row: the newest snapshot version of the table, and whether it is the loaded one."""
    return streets.agg(F.max("snapshot_version").alias("version")).withColumn("same", F.coalesce(F.col("version") == loaded, F.lit(False)))


def authorized(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """The requests whose api_key's hash is among live keys (key_hash, revoked)."""
    live = keys.where("NOT revoked").select(F.col("key_hash").alias("_hash"))
    return requests.withColumn("_hash", F.sha2("api_key", 256)).join(live, "_hash", "left_semi").drop("_hash", "api_key")


def batch_errors(items: DataFrame, most: int = 5000, most_bytes: int = 64 << 20) -> DataFrame:
    """batch_id, n, error of (batch_id, address): no batch is empty by having rows; too many or too large ones are refused."""
    g = items.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("address"), F.lit(0))).alias("bytes"))
    return g.select("batch_id", "n", F.when(F.col("n") > most, "TOO_MANY").when(F.col("bytes") > most_bytes, "TOO_LARGE").otherwise("").alias("error"))


def verified_export(tickets: DataFrame) -> DataFrame:
    """Closed tickets in order of their closing, with the fields of their resolution (JSON text) and an ISO time."""
    field = lambda name: F.get_json_object("resolution", f"$.{name}")
    d = tickets.where(F.col("status").isin("resolved", "unresolvable"))
    return d.select("ticket_id", "status", field("lat").cast("double").alias("lat"), field("lng").cast("double").alias("lng"), field("note").alias("note"), F.date_format("resolved_at", "yyyy-MM-dd'T'HH:mm:ss").alias("resolved_at")).orderBy("resolved_at", "ticket_id")
