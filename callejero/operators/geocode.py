"""From a normalized address to a place and a decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored
from . import locate as loc, resolve as res

AREA_SCORE = 0.7


def published(streets: DataFrame, segments: DataFrame, anchors: DataFrame, crossings: DataFrame, marks: DataFrame, areas: DataFrame, centroids: DataFrame, hints: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a gazetteer that ``geocode`` reads; publish them (``sources.files.publish``) once a version.

    ``areas`` is (ubigeo, key, lng, lat), ``centroids`` (ubigeo, lng, lat), each with one row per key;
    ``hints`` are those of parallel streets unless others are given.
    """
    axis = stored(loc.with_segments(loc.frames(segments), segments), "street-axes")
    hints = loc.parallel_hints(segments, anchors, axis) if hints is None else hints
    n = anchors.groupBy("street_id").agg(F.count("*").alias("n_anchors"))
    named = streets.join(n, "street_id", "left").withColumn("n_anchors", F.coalesce("n_anchors", F.lit(0)))
    indexed = streets.select("ubigeo").union(areas.select("ubigeo")).distinct()
    return {"streets": named, "indexed": indexed, "areas": areas, "centroids": centroids} | loc.prepared(segments, anchors, crossings, marks, hints, axis)


def geocode(read: DataFrame, g: dict[str, DataFrame], verified: DataFrame) -> DataFrame:
    """One row per row of ``read`` (req_id and the normalizer's columns).

    Scope first, then verified addresses, streets, the named area, the district's centroid. Only
    candidates within the band of a request's best score are placed. ``g`` holds the tables of
    ``published``; ``verified`` is (address_hash, lng, lat, method), one row a hash.
    """
    streets, areas, centroids = g["streets"], g["areas"], g["centroids"]
    named = F.when(F.col("urbanization") != "", T.area_key(F.col("urbanization")))
    r = read.select(
        "req_id", F.col("loc_ubigeo").alias("ubigeo"), "in_scope", "flags", "normalized", F.col("street_type").alias("req_type"), T.key(F.col("street_name")).alias("req_key"),
        T.phonetic(F.col("street_name")).alias("req_phon"), "number", T.house_number(F.col("number")).alias("num"), named.alias("area_key"),
        F.when(F.col("match_key") != "", T.address_hash(F.col("match_key"), F.col("loc_ubigeo"))).alias("address_hash"),
    )
    r = r.join(areas.select("ubigeo", F.col("key").alias("area_key"), F.col("lng").alias("near_lng"), F.col("lat").alias("near_lat")), ["ubigeo", "area_key"], "left")
    r = r.join(g["indexed"].withColumn("indexed", F.lit(True)), "ubigeo", "left")
    r = r.join(verified.select("address_hash", F.struct("lng", "lat", "method").alias("v")), "address_hash", "left")
    r = r.join(centroids.select("ubigeo", F.struct("lng", "lat").alias("centre")), "ubigeo", "left")
    # The normalizer's reading and the candidates are built once; all that follows reads them several times.
    r = stored(r, "geocode-requests")
    live = (F.col("ubigeo") != "") & F.coalesce("in_scope", F.lit(False))
    asked = r.where(live & F.col("v").isNull() & (F.col("req_key") != ""))

    # Streets are sought once a name, and placed and chosen once an address: batches repeat both.
    name = ["ubigeo", "req_type", "req_key", "req_phon"]
    address = [*name, "num", "near_lng", "near_lat"]
    once = stored(asked.select(*address).distinct().withColumn("address_id", F.monotonically_increasing_id()), "geocode-addresses")
    names = stored(once.select(*name).distinct().withColumn("req_id", F.monotonically_increasing_id()), "geocode-names")
    found = res.candidates(names, streets).withColumn("best", F.max("score").over(Window.partitionBy("req_id"))).where(F.col("score") >= F.col("best") - res.BAND).drop("best")
    found = found.join(names, "req_id").drop("req_id")
    pairs = once.join(found, name).withColumnRenamed("address_id", "req_id").drop(*name)
    pairs = stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "geocode-pairs")
    at = loc.on_street(pairs, g).select(*pairs.columns, F.struct("lng", "lat", "precision", "tight", "note").alias("at"), "area_m")
    full = at.join(streets.select("street_id", "key", "type", "name", "n_anchors"), "street_id")
    full = stored(full, "geocode-places").withColumn("covers", F.col("at.precision").isin("ADDRESS_POINT", "SEGMENT_INTERPOLATED"))
    chosen = res.pick(full.select("req_id", "street_id", "key", "score", "n_anchors", "covers", "area_m"))
    hit = chosen.join(full.select("req_id", "street_id", "match", "score", "at", F.trim(F.concat_ws(" ", "type", "name")).alias("street")), ["req_id", "street_id"])

    by = once.select(*[F.col(c).alias(f"_{c}") for c in address], "address_id")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in address])
    known = r.join(by, same & live & F.col("v").isNull(), "left").drop(*[f"_{c}" for c in address])
    d = known.join(hit.withColumnRenamed("flag", "how").withColumnRenamed("req_id", "address_id"), "address_id", "left")
    case = (
        F.when(F.col("ubigeo") == "", "NO_DISTRICT").when(~live, "OUT_OF_SCOPE").when(F.col("v").isNotNull(), "VERIFIED").when(F.col("at").isNotNull(), F.col("match"))
        .when(F.col("near_lng").isNotNull(), "AREA_MATCH").when(F.col("centre").isNotNull(), "DISTRICT_CENTROID").otherwise("NONE")
    )
    d = d.withColumn("case", case).withColumn("on", (F.col("case") != "VERIFIED") & F.col("at").isNotNull())
    empty = F.array().cast("array<string>")
    one = lambda flag: F.array(flag)
    doubt = (
        F.when(F.col("at.note") != "", one(F.col("at.note"))).when(~F.col("at.tight") & (F.col("at.precision") != "STREET"), one(F.lit("WIDE_INTERPOLATION")))
        .when(~F.col("at.tight"), one(F.lit("LONG_STREET_WITHOUT_ANCHOR"))).otherwise(empty)
    )
    more = (
        F.when(F.col("case") == "VERIFIED", one(F.concat(F.lit("VERIFIED_"), F.upper("v.method"))))
        .when(F.col("on"), F.concat(F.when(F.col("how") != "", one(F.col("how"))).otherwise(empty), F.when(F.col("ambiguous"), one(F.lit("AMBIGUOUS_STREET"))).otherwise(empty), doubt))
        .when(live & F.col("indexed") & (F.col("req_key") != ""), one(F.lit("STREET_NOT_FOUND"))).otherwise(empty)
    )
    decision = (
        F.when(F.col("case") == "OUT_OF_SCOPE", "REJECT").when(F.col("case") == "VERIFIED", "AUTO_ACCEPT")
        .when(F.col("on"), res.decide(F.col("flags"), F.col("ambiguous"), F.col("at.precision"), F.col("at.tight"), F.col("match"), F.col("score")))
        .when((F.col("case") == "AREA_MATCH") & (F.col("req_key") == ""), "ACCEPT_FLAGGED").otherwise("REVIEW")
    )
    point = lambda axis: F.when(F.col("case") == "VERIFIED", F.col(f"v.{axis}")).when(F.col("on"), F.col(f"at.{axis}")).when(F.col("case") == "AREA_MATCH", F.col(f"near_{axis}")).when(F.col("case") == "DISTRICT_CENTROID", F.col(f"centre.{axis}"))
    precision = F.when(F.col("case") == "VERIFIED", "ADDRESS_POINT").when(F.col("on"), F.col("at.precision")).when(F.col("case") == "AREA_MATCH", "ZONE").when(F.col("case") == "DISTRICT_CENTROID", "DISTRICT")
    door = F.when(F.col("number").isin("", "S/N"), None).otherwise(F.col("number"))
    reason = F.when(F.col("case") == "NO_DISTRICT", "sin distrito").when(F.col("case") == "OUT_OF_SCOPE", "fuera de las zonas activas").when(F.col("case").isin("DISTRICT_CENTROID", "NONE"), "sin calle ni zona en el índice").otherwise("")
    return d.select(
        "req_id", "ubigeo", F.when(F.col("on"), F.col("street_id")).alias("street_id"), "case", precision.alias("precision"), decision.alias("decision"), point("lng").alias("lng"), point("lat").alias("lat"),
        F.round(F.when(F.col("case") == "VERIFIED", 1.0).when(F.col("on"), F.col("score")).when(F.col("case") == "AREA_MATCH", AREA_SCORE).otherwise(0.0), 3).alias("score"),
        F.concat("flags", more).alias("flags"), F.when(F.col("case") == "VERIFIED", F.col("normalized")).when(F.col("on"), F.concat_ws(" ", "street", door)).otherwise("").alias("canonical"), reason.alias("reason"),
    ).select(
        "req_id", res.status_of(F.col("decision")).alias("status"), "decision",
        F.when(F.col("case").isin("NO_DISTRICT", "OUT_OF_SCOPE", "NONE"), None).otherwise(F.col("case")).alias("resolution"), "precision", "score", "lng", "lat", "ubigeo", "street_id", "canonical", "flags", "reason",
    )
