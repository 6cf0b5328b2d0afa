"""Matching a normalized address to streets, ranking, picking and deciding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SCORES = {"EXACT": 1.0, "ALIAS": 0.995, "PHONETIC": 0.93, "PARTIAL": 0.88, "OSM_OTHER_NAME": 0.75}
FUZZY_LEAST, FUZZY_FACTOR, TYPE_PENALTY, BAND, REPORTED = 0.82, 0.9, 0.08, 0.05, 4
STOP_TOKENS = ("LOS", "LAS", "DEL", "SAN", "SANTA")
REASONS = ("DISTRICT_CONFLICT", "AMBIGUOUS_STREET", "STREET_NOT_FOUND", "LONG_STREET_WITHOUT_ANCHOR", "AMBIGUOUS_LIMA", "DUPLICATED_TEXT")


def street_names(streets: DataFrame) -> DataFrame:
    """ubigeo, name_key, kind, street_id: own name, its phonetic form, and aliases (promoted or alike: ALIAS; else OSM_OTHER_NAME)."""
    own = streets.select("ubigeo", "street_id", F.explode(F.array(F.struct(F.col("key").alias("name_key"), F.lit("EXACT").alias("kind")), F.struct(T.phonetic(F.col("name")).alias("name_key"), F.lit("PHONETIC").alias("kind")))).alias("n"))
    other = streets.select("ubigeo", "street_id", "key", "promoted", F.explode("aliases").alias("alias"))
    alias = F.when(F.array_contains("promoted", F.col("alias")) | T.same_name(F.col("alias"), F.col("key")), "ALIAS").otherwise("OSM_OTHER_NAME")
    return own.select("ubigeo", "street_id", "n.name_key", "n.kind").unionByName(other.select("ubigeo", "street_id", F.col("alias").alias("name_key"), alias.alias("kind")))


def scored(hits: DataFrame) -> DataFrame:
    """Best score per request and street; a type that differs costs."""
    differs = (F.col("req_type") != "") & (F.col("type") != "") & (F.col("req_type") != F.col("type"))
    s = hits.withColumn("score", F.col("score") - F.when(differs, TYPE_PENALTY).otherwise(0.0))
    rank = F.struct("score", F.element_at(F.create_map(*[F.lit(x) for k, v in (("EXACT", 6), ("ALIAS", 5), ("OSM_OTHER_NAME", 4), ("PHONETIC", 3), ("PARTIAL", 2), ("FUZZY", 1)) for x in (k, v)]), F.col("kind")))
    return s.groupBy("req_id", "street_id").agg(F.max_by("kind", rank).alias("match"), F.max("score").alias("score"))


def candidates(requests: DataFrame, streets: DataFrame) -> DataFrame:
    """req_id, street_id, match, score for (req_id, ubigeo, req_type, req_key, req_phon) against (street_id, ubigeo, type, name, key, aliases, promoted).

    Names are one equi-join on district and name. Only requests without a hit go on to the
    token index: streets that share a word of three letters or more are compared as subset
    or by edit distance.
    """
    r = requests.select("req_id", "ubigeo", "req_type", "req_key", "req_phon")
    kinds = street_names(streets).join(streets.select("street_id", "type"), "street_id")
    wanted = r.select("*", F.explode(F.array(F.struct(F.col("req_key").alias("name_key"), F.lit(False).alias("by_sound")), F.struct(F.col("req_phon").alias("name_key"), F.lit(True).alias("by_sound")))).alias("w")).select("req_id", "ubigeo", "req_type", "w.name_key", "w.by_sound")
    score = F.element_at(F.create_map(*[F.lit(x) for k, v in SCORES.items() for x in (k, v)]), F.col("kind"))
    named = wanted.where("name_key <> ''").join(kinds, ["ubigeo", "name_key"]).where((F.col("kind") == "PHONETIC") == F.col("by_sound")).select("req_id", "street_id", "req_type", "type", "kind", score.alias("score"))
    rest = r.join(named.select("req_id").distinct(), "req_id", "left_anti")
    tokens = lambda c: F.filter(F.split(c, " "), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_TOKENS))
    left = rest.select("req_id", "ubigeo", "req_type", "req_key", F.explode(tokens(F.col("req_key"))).alias("token"))
    right = streets.select("street_id", "ubigeo", "type", "key", F.explode(tokens(F.col("key"))).alias("token"))
    pairs = left.join(right, ["ubigeo", "token"]).select("req_id", "street_id", "req_type", "type", "req_key", "key").distinct()
    a, b, alike = F.split("req_key", " "), F.split("key", " "), T.similarity(F.col("req_key"), F.col("key"))
    kind = F.when(T.subset(a, b) | T.subset(b, a), "PARTIAL").when(alike >= FUZZY_LEAST, "FUZZY")
    loose = pairs.withColumn("kind", kind).where("kind IS NOT NULL").select("req_id", "street_id", "req_type", "type", "kind", F.when(F.col("kind") == "PARTIAL", SCORES["PARTIAL"]).otherwise(FUZZY_FACTOR * alike).alias("score"))
    return scored(named.unionByName(loose))


def top_candidates(found: DataFrame, anchors: DataFrame, k: int = REPORTED) -> DataFrame:
    """The k best per request: score, then number of anchors, then street id; scores rounded to three places."""
    n = anchors.groupBy("street_id").agg(F.count("*").alias("n_anchors"))
    w = Window.partitionBy("req_id").orderBy(F.desc("score"), F.desc("n_anchors"), "street_id")
    d = found.join(n, "street_id", "left").withColumn("n_anchors", F.coalesce("n_anchors", F.lit(0)))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("req_id", "rank", "street_id", "match", F.round("score", 3).alias("score"))


def pick(found: DataFrame) -> DataFrame:
    """req_id, street_id, ambiguous, flag from (req_id, street_id, key, score, n_anchors, covers, area_m).

    Within a band of the best score: one street wins; streets of other names are ambiguous;
    among homonyms the only one whose numbers cover the request, or the one clearly nearest to
    the named area.
    """
    best = Window.partitionBy("req_id")
    top = found.withColumn("best", F.max("score").over(best)).where(F.col("score") >= F.col("best") - BAND)
    order = F.struct(-F.col("score"), -F.col("n_anchors"), "street_id")
    g = top.groupBy("req_id").agg(
        F.count("*").alias("n"), F.min_by("street_id", order).alias("first"), F.count_distinct("key").alias("names"),
        F.count_if("covers").alias("n_covers"), F.min_by("street_id", F.struct(~F.col("covers"), order)).alias("covering"),
        F.min_by("street_id", F.struct(F.coalesce("area_m", F.lit(1e18)), order)).alias("closest"), F.sort_array(F.collect_list("area_m")).alias("ms"),
    )
    d1, d2 = F.get("ms", F.lit(0)), F.get("ms", F.lit(1))
    by_number = (F.col("n") > 1) & (F.col("names") == 1) & (F.col("n_covers") == 1)
    by_area = (F.col("n") > 1) & (F.col("names") == 1) & (d1 <= 800) & (d2.isNull() | (d2 >= 2 * d1 + 200))
    flag = F.when(by_number, "STREET_BY_NUMBER_COVERAGE").when(F.coalesce(by_area, F.lit(False)), "STREET_BY_AREA").otherwise("")
    g = g.withColumn("flag", flag)
    street = F.when(F.col("flag") == "STREET_BY_NUMBER_COVERAGE", F.col("covering")).when(F.col("flag") == "STREET_BY_AREA", F.col("closest")).otherwise(F.col("first"))
    return g.select("req_id", street.alias("street_id"), ((F.col("n") > 1) & (F.col("flag") == "")).alias("ambiguous"), "flag")


def decide(flags: Column, ambiguous: Column, precision: Column, tight: Column, kind: Column, score: Column) -> Column:
    held = F.exists(flags, lambda f: f.isin("DISTRICT_CONFLICT", "AMBIGUOUS_LIMA", "DUPLICATED_TEXT"))
    sure = kind.isin("EXACT", "ALIAS") & (score >= 0.99) & tight & (precision != "STREET")
    return F.when(held | ambiguous | ((precision == "STREET") & ~tight), "REVIEW").when(sure, "AUTO_ACCEPT").when(score >= 0.8, "ACCEPT_FLAGGED").otherwise("REVIEW")


def status_of(decision: Column) -> Column:
    return F.when(decision == "REJECT", "OUT_OF_SCOPE").when(decision == "REVIEW", "REVIEW_REQUIRED").when(decision.isin("AUTO_ACCEPT", "ACCEPT_FLAGGED"), "RESOLVED").otherwise("UNRESOLVED")


def reason_of(flags: Column) -> Column:
    """The first flag that says why an address needs a review."""
    return F.coalesce(F.get(F.filter(flags, lambda f: f.isin(*REASONS)), F.lit(0)), F.lit("REVIEW"))


def find_streets(streets: DataFrame, anchors: DataFrame, ubigeo: str, part: str, limit: int) -> DataFrame:
    """Streets of a district whose key contains ``part``: those without anchors first, then by name and id."""
    n = anchors.groupBy("street_id").agg(F.count("*").alias("n_anchors"))
    d = streets.where((F.col("ubigeo") == ubigeo) & F.col("key").contains(part)).join(n, "street_id", "left").withColumn("n_anchors", F.coalesce("n_anchors", F.lit(0)))
    return d.orderBy((F.col("n_anchors") > 0), "name", "street_id").limit(limit).select("street_id", "name", "n_anchors")


def with_edits(anchors: DataFrame, edits: DataFrame) -> DataFrame:
    """A snapshot's anchors (street_id, number, lng, lat, ref) under live edits: those of an edited number and all made by hand give way; an edit counts once."""
    kept = anchors.where(~F.col("ref").startswith("manual:")).join(edits.select("street_id", "number").distinct(), ["street_id", "number"], "left_anti")
    columns = ("street_id", "number", "lng", "lat", "ref")
    return kept.select(*columns).unionByName(edits.select(*columns))


def street_hundreds(anchors: DataFrame) -> DataFrame:
    """street_id, hundred, n_numbers, first, last: what is known of each block of a street."""
    hundred = F.floor(F.col("number") / 100).cast("int").alias("hundred")
    return anchors.groupBy("street_id", hundred).agg(F.count("*").alias("n_numbers"), F.min("number").alias("first"), F.max("number").alias("last"))
