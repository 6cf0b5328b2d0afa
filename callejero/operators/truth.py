"""Truth from delivery GPS: validity, medoid, contradiction, quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.shared import stored
from .gazetteer import reached

ARRIVAL_M, IDENTICAL_M, CLUSTER_M, BATCH = 50, 1, 30, 3
#: Distinct points of an address that are compared in an array, and the side of the cells beyond that.
FEW, CELL_M = 256, 1.0


def latest_events(events: DataFrame, keys: tuple[str, ...] = ("order_id", "kind")) -> DataFrame:
    """The last event of each key; ties to the larger event id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deliveries(events: DataFrame, orders: DataFrame, now: Column, days: int = 90, areas: tuple[str, ...] = ("1501", "0701")) -> DataFrame:
    """order_id, day, lat, lng, arr_lat, arr_lng and the orders' address columns: where each live, direct order was delivered, and where the driver had arrived.

    The last event of each code (EMC delivered, LPE arrived) of the past ``days`` that has a place counts;
    ties go to the larger event id. ``events`` is (event_id, order_id, code, ts, lat, lng), ``orders``
    (order_id, state, logistics, address, ubigeo, ...); only orders with an address in ``areas`` are kept.
    """
    placed = (F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lng", F.lit(0.0)) != 0)
    live = events.where(F.col("code").isin("EMC", "LPE") & placed & (F.col("ts") >= now - F.make_dt_interval(days=F.lit(days))))
    of = lambda code: F.when(F.col("code") == code, F.struct("ts", "event_id", "lat", "lng"))
    both = live.groupBy("order_id").agg(F.max(of("EMC")).alias("e"), F.max(of("LPE")).alias("l")).where("e IS NOT NULL")
    kept = orders.where((F.col("state") == "A") & (F.col("logistics") == "LOGISTICA_DIRECTA") & F.left("ubigeo", F.lit(4)).isin(*areas) & (F.trim(F.coalesce("address", F.lit(""))) != ""))
    six = lambda c: F.round(c, 6)
    d = both.select("order_id", F.to_date("e.ts").alias("day"), six("e.lat").alias("lat"), six("e.lng").alias("lng"), six("l.lat").alias("arr_lat"), six("l.lng").alias("arr_lng"))
    return d.join(kept.drop("state", "logistics"), "order_id")


def addressed(read: DataFrame) -> DataFrame:
    """``read`` (deliveries with the normalizer's columns) with addr_key, the normalized address and its district; those without either are left out."""
    return read.where("match_key <> '' AND loc_ubigeo <> ''").withColumn("addr_key", F.concat_ws("|", "match_key", "loc_ubigeo"))


def batch_counts(deliveries: DataFrame, reach: float = CLUSTER_M) -> DataFrame:
    """delivery_id, batch: deliveries of other addresses on the same day within ``reach`` metres; itself counts once.

    Deliveries of one day and place are compared as one, with their number: all those around a
    place, less those of the delivery's own address.
    """
    a = deliveries.select("delivery_id", "addr_key", "day", "lng", "lat")
    known, side = a.where("addr_key IS NOT NULL"), 2 * reach / geo.DEGREE_M

    def around(keys: list[str], label: str) -> DataFrame:
        """``keys``, lng, lat, ``label``: how many deliveries with these keys are within reach of each place."""
        spots = known.groupBy(*keys, "lng", "lat").agg(F.count("*").alias("m"))
        others = spots.select(*keys, F.col("lng").alias("o_lng"), F.col("lat").alias("o_lat"), "m", F.explode(reached(F.col("lng"), F.col("lat"), reach, side)).alias("c"))
        near = spots.drop("m").withColumn("c", reached(F.col("lng"), F.col("lat"), 0, side)[0]).join(others, [*keys, "c"])
        near = near.where(geo.distance(F.col("lng"), F.col("lat"), F.col("o_lng"), F.col("o_lat")) <= reach)
        return near.groupBy(*keys, "lng", "lat").agg(F.sum("m").alias(label))

    n = around(["day", "addr_key"], "own").join(around(["day"], "met"), ["day", "lng", "lat"])
    d = a.join(n, ["day", "addr_key", "lng", "lat"], "left")
    return d.select("delivery_id", (F.coalesce(F.col("met") - F.col("own"), F.lit(0)) + 1).cast("int").alias("batch"))


def judged(deliveries: DataFrame) -> DataFrame:
    """Adds ``reason``: why a delivery does not count, or the empty text; from lng, lat, arr_lng, arr_lat, batch, in_district."""
    d = geo.distance(F.col("lng"), F.col("lat"), F.col("arr_lng"), F.col("arr_lat"))
    reason = F.when(F.col("arr_lng").isNull(), "sin_llegada").when(d > ARRIVAL_M, "lejos_de_la_llegada").when(d < IDENTICAL_M, "llegada_identica").when(F.col("batch") >= BATCH, "marcada_en_lote").when(~F.col("in_district"), "fuera_del_distrito").otherwise("")
    return deliveries.withColumn("reason", reason)


def medoids(points: DataFrame, few: int = FEW) -> DataFrame:
    """addr_key, lng, lat, far of (addr_key, delivery_id, lng, lat): the point of least total distance to all others of its address (ties: smaller id), and whether one of them is over CLUSTER_M away.

    Where an address's points spread over more than twice that, one is far from any medoid, so none is
    sought. Equal points count as one with their number. Up to ``few`` distinct points of an
    address are compared in an array. Beyond that, cells of CELL_M bound each point's cost from
    both sides (by the convexity of distances: from below by the distance to a cell's centroid, from
    above by the root of its square plus the cell's variance), and only points whose lower bound
    is within the least upper one are compared with all; a cell table has some thousand rows an address at most.
    """
    k, scale = F.cos(F.radians(F.max("lat"))), geo.RADIUS * math.pi / 180
    wide = F.greatest((F.max("lng") - F.min("lng")) * k * scale, (F.max("lat") - F.min("lat")) * scale) > 2 * CLUSTER_M + 1
    spots = points.groupBy("addr_key", "lng", "lat").agg(F.count("*").alias("n"), F.min("delivery_id").alias("first"))
    boxes = stored(spots.groupBy("addr_key").agg(wide.alias("wide"), F.count("*").alias("spots"), F.min("lng").alias("x0"), F.min("lat").alias("y0")), "truth-boxes")
    apart = lambda p, q: geo.distance(p["lng"], p["lat"], q["lng"], q["lat"])

    tight = boxes.where("NOT wide")
    small = spots.join(tight.where(F.col("spots") <= few).select("addr_key"), "addr_key")
    g = small.groupBy("addr_key").agg(F.sort_array(F.collect_list(F.struct("first", "lng", "lat", "n"))).alias("p"))
    cost = lambda a: F.round(F.aggregate("p", F.lit(0.0), lambda total, b: total + b["n"] * apart(a, b)), 6)
    g = g.withColumn("m", F.array_min(F.transform("p", lambda a: F.struct(cost(a).alias("cost"), a.alias("at"))))["at"])
    of_small = g.select("addr_key", "m.lng", "m.lat", F.exists("p", lambda x: apart(x, F.col("m")) > CLUSTER_M).alias("far"))

    many = stored(spots.join(tight.where(F.col("spots") > few).select("addr_key", "x0", "y0"), "addr_key"), "truth-spots")
    step = CELL_M / scale
    cell = (F.floor((F.col("lng") - F.col("x0")) / step).alias("cx"), F.floor((F.col("lat") - F.col("y0")) / step).alias("cy"))
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    centres = many.groupBy("addr_key", *cell).agg(F.sum("n").alias("n"), mean("lng"), mean("lat"))
    placed = many.select("addr_key", *cell, F.col("lng").alias("p_lng"), F.col("lat").alias("p_lat"), F.col("n").alias("p_n"))
    off = geo.distance(F.col("lng"), F.col("lat"), F.col("p_lng"), F.col("p_lat"))
    cells_ = placed.join(centres, ["addr_key", "cx", "cy"]).groupBy("addr_key", "cx", "cy", "n", "lng", "lat").agg((F.sum(off * off * F.col("p_n")) / F.first("n")).alias("var"))
    tables = cells_.groupBy("addr_key").agg(F.collect_list(F.struct("lng", "lat", "n", "var")).alias("cells"))
    here = F.struct("lng", "lat")
    total = lambda f: F.aggregate("cells", F.lit(0.0), lambda t, c: t + c["n"] * f(apart(here, c), c))
    # Distances are flat only to a few parts in a million, which the margins cover.
    bounded = many.join(tables, "addr_key").select("addr_key", "first", "lng", "lat", (total(lambda d, c: d) * (1 - 1e-5)).alias("low"), (total(lambda d, c: F.sqrt(d * d + c["var"])) * (1 + 1e-5) + 1e-6).alias("high"))
    bounded = stored(bounded, "truth-bounds")
    least = bounded.groupBy("addr_key").agg(F.min("high").alias("least"))
    tried = bounded.join(least, "addr_key").where("low <= least").select("addr_key", F.col("first").alias("c_first"), F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat"))
    d = geo.distance(F.col("c_lng"), F.col("c_lat"), F.col("lng"), F.col("lat"))
    costs = tried.join(many.select("addr_key", "lng", "lat", "n"), "addr_key").groupBy("addr_key", "c_first", "c_lng", "c_lat").agg(F.round(F.sum(F.col("n") * d), 6).alias("cost"), (F.max(d) > CLUSTER_M).alias("far"))
    best = costs.groupBy("addr_key").agg(F.min_by(F.struct("c_lng", "c_lat", "far"), F.struct("cost", "c_first")).alias("b"))
    of_many = best.select("addr_key", F.col("b.c_lng").alias("lng"), F.col("b.c_lat").alias("lat"), "b.far")
    spread = boxes.where("wide").select("addr_key", F.lit(None).cast("double").alias("lng"), F.lit(None).cast("double").alias("lat"), F.lit(True).alias("far"))
    return of_small.unionByName(of_many).unionByName(spread)


def resolve(deliveries: DataFrame, few: int = FEW) -> DataFrame:
    """addr_key, lng, lat, quality, reason, valid from judged deliveries, by the medoid of those that count."""
    good = F.col("reason") == ""
    g = deliveries.groupBy("addr_key").agg(F.count_if(good).cast("int").alias("valid"), F.count_distinct(F.when(good, F.col("day"))).alias("days"))
    m = medoids(deliveries.where(good).select("addr_key", "delivery_id", "lng", "lat"), few)
    why = deliveries.where(~good).groupBy("addr_key", "reason").agg(F.count("*").alias("n"))
    top = why.groupBy("addr_key").agg(F.min_by("reason", F.struct(-F.col("n"), "reason")).alias("why"))
    d = g.join(m, "addr_key", "left").join(top, "addr_key", "left")
    state = F.when(F.col("valid") == 0, "none").when(F.col("far"), "far").when(F.col("days") >= 2, "gold").otherwise("silver")
    d = d.withColumn("s", state)
    kept = F.col("s").isin("gold", "silver")
    return d.select(
        "addr_key", F.when(kept, F.col("lng")).alias("lng"), F.when(kept, F.col("lat")).alias("lat"),
        F.when(F.col("s") == "gold", "oro").when(F.col("s") == "silver", "plata").otherwise("").alias("quality"),
        F.when(F.col("s") == "gold", "entregas_coinciden_en_dias_distintos").when(F.col("s") == "silver", "una_sola_fecha").when(F.col("s") == "far", "entregas_contradictorias").otherwise(F.concat(F.lit("sin_entregas_validas:"), "why")).alias("reason"),
        "valid",
    )
