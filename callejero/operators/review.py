"""The review queue, derived from append-only events; and the evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

THRESHOLDS = {"ADDRESS_POINT": 50, "SEGMENT_INTERPOLATED": 50, "STREET": 150, "ZONE": 300, "DISTRICT": 300}


def tickets(events: DataFrame) -> DataFrame:
    """One live ticket per address: occurrences, priority, and the last street seen; from (address_key, event_id, street_id, status)."""
    live = events.where(F.col("status").isin("open", "assigned", "escalated"))
    return live.groupBy("address_key").agg(F.count("*").alias("occurrences"), (F.count("*") - 1).alias("priority"), F.max_by("street_id", "event_id").alias("street_id"))


def queue(ticket_table: DataFrame, limit: int, by_yield: bool = True) -> DataFrame:
    """The queue's head: tickets of the streets that settle most occurrences first."""
    of_street = F.sum("occurrences").over(Window.partitionBy("street_id"))
    d = ticket_table.withColumn("street_yield", F.when(F.col("street_id").isNull(), F.col("occurrences")).otherwise(of_street))
    first = [F.desc("street_yield"), F.col("street_id").asc_nulls_last()] if by_yield else []
    return d.orderBy(*first, F.desc("occurrences"), "address_key").limit(limit)


def latest_pins(pins: DataFrame) -> DataFrame:
    w = Window.partitionBy("address_key").orderBy(F.desc("created_at"), F.desc("pin_id"))
    return pins.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def audit_failures(rows: DataFrame) -> DataFrame:
    """AUTO_ACCEPT rows whose error passes their precision's threshold, outside the test split."""
    most = F.element_at(F.create_map(*[F.lit(x) for k, v in THRESHOLDS.items() for x in (k, v)]), F.col("precision"))
    return rows.where((F.col("decision") == "AUTO_ACCEPT") & (F.col("split") != "test") & (F.col("error_m") > most))


def stratified(rows: DataFrame, per_group: int, limit: int, group: str, order: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_group).orderBy("_n", order).limit(limit).drop("_n")


def order_sample(orders: DataFrame, now: Column, days: int = 90, per_account: int = 40, total: int = 600) -> DataFrame:
    """A sample of customers' addresses: pseudonymous, masked, each address of an account once, at most ``per_account`` of an account, in hash order.

    The customer's side of a direct order is its destination (columns ``*_to``), of an inverse one its
    origin (``*_from``). ``orders`` is (order_id, account, state, logistics, created_at) and address, number, ubigeo of both sides.
    """
    inverse = F.col("logistics") == "LOGISTICA_INVERSA"
    side = lambda c: F.when(inverse, F.col(f"{c}_from")).otherwise(F.col(f"{c}_to")).alias(c)
    masked = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\s@]+@[^\s@]+", "<CORREO>"), "[0-9]{7,}", "<NUM>")
    live = orders.where((F.col("state") == "A") & (F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days))))
    d = live.select("account", F.md5(F.col("order_id").cast("string")).alias("hash"), F.when(inverse, "ORIGEN").otherwise("DESTINO").alias("side"), side("address"), side("number"), side("ubigeo"))
    d = d.where(F.trim(F.coalesce("address", F.lit(""))) != "").withColumn("address", masked("address"))
    same = ("account", F.lower(F.trim("address")).alias("_a"), F.coalesce("number", F.lit("")).alias("_n"), F.coalesce("ubigeo", F.lit("")).alias("_u"))
    once = d.groupBy(*same).agg(F.min_by(F.struct("hash", "side", "address", "number", "ubigeo"), "hash").alias("r")).select("account", "r.*")
    w = Window.partitionBy("account").orderBy("hash")
    few = once.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_account).orderBy("hash").limit(total)
    return few.select(F.left("hash", F.lit(12)).alias("sample_id"), "account", "side", "address", "number", "ubigeo")


def floor_rank(values: str, p: float) -> Column:
    """The element at floor(p * (n - 1)) of the sorted values."""
    lst = F.sort_array(F.collect_list(values))
    return F.element_at(lst, F.floor(p * (F.size(lst) - 1)).cast("int") + 1)


def error_table(rows: DataFrame, *by: str) -> DataFrame:
    """n, median, p90, share within 50 and 150 m, share beyond the precision's threshold."""
    most = F.element_at(F.create_map(*[F.lit(x) for k, v in THRESHOLDS.items() for x in (k, v)]), F.col("precision"))
    share = lambda cond: F.round(100.0 * F.count_if(cond) / F.count("*"), 3)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), floor_rank("error_m", 0.5).alias("median"), floor_rank("error_m", 0.9).alias("p90"),
        share(F.col("error_m") <= 50).alias("within_50"), share(F.col("error_m") <= 150).alias("within_150"), share(F.col("error_m") > most).alias("beyond"),
    )


def field_accuracy(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """split, source (null: all), n, the share right of each field, and core: all of them; one pass by grouping sets."""
    right = {f: F.col(f"exp_{f}") == F.col(f"got_{f}") for f in fields}
    core = None
    for c in right.values():
        core = c if core is None else core & c
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 3)
    return rows.rollup("split", "source").agg(F.count("*").alias("n"), *[share(c).alias(f"pct_{f}") for f, c in right.items()], share(core).alias("pct_core"), F.grouping_id().alias("level")).where("level < 3").drop("level")


def outcome(expected: Column, got: Column) -> Column:
    return F.when(expected == got, "correcto").when(F.coalesce(got, F.lit("")) == "", "abstencion").otherwise("equivocado")


def frequent_flags(rows: DataFrame, k: int = 15) -> DataFrame:
    return rows.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag").limit(k)


def latency_histogram(events: DataFrame, buckets: tuple[int, ...] = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000)) -> DataFrame:
    """route, le, n: cumulative counts, from one aggregation over all bounds."""
    g = events.groupBy("route").agg(*[F.count_if(F.col("ms") <= b).alias(f"b{b}") for b in buckets])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("n")) for b in buckets])
    return g.select("route", F.inline(pairs))


def resolved_once(requests: DataFrame, keys: tuple[str, ...], resolve) -> DataFrame:
    """Resolve each distinct request once and give every row its result."""
    once = resolve(requests.select(*keys).distinct())
    cond = None
    for k in keys:
        c = requests[k].eqNullSafe(once[k])
        cond = c if cond is None else cond & c
    return requests.join(once, cond).select(requests["*"], *[once[c] for c in once.columns if c not in keys])


def coverage(streets: DataFrame, anchors: DataFrame) -> DataFrame:
    """street_id, n_anchors, hundreds, coverage: completa (a number in each hundred between the first and last), parcial or sin_datos."""
    hundred = F.floor(F.col("number") / 100)
    a = anchors.groupBy("street_id").agg(F.count("*").alias("n_anchors"), F.count_distinct(hundred).alias("hundreds"), (F.max(hundred) - F.min(hundred) + 1).alias("span"))
    d = streets.select("street_id").join(a, "street_id", "left")
    state = F.when(F.col("n_anchors").isNull(), "sin_datos").when(F.col("hundreds") == F.col("span"), "completa").otherwise("parcial")
    return d.select("street_id", F.coalesce("n_anchors", F.lit(0)).alias("n_anchors"), F.coalesce("hundreds", F.lit(0)).alias("hundreds"), state.alias("coverage"))


def worst_groups(rows: DataFrame, by: str, right: Column, k: int = 10) -> DataFrame:
    """The k groups of the least share right; ties by name."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(right) / F.count("*"), 3).alias("pct")).orderBy("pct", by).limit(k)


def prometheus(histogram: DataFrame, name: str) -> DataFrame:
    """Text lines of a cumulative histogram (route, le, n)."""
    return histogram.select(F.format_string(name + '_bucket{route="%s",le="%d"} %d', "route", "le", "n").alias("line"))


def profile(rows: DataFrame, parts: dict[str, Column], expected: Column, got: Column) -> DataFrame:
    """shape (names of the parts that are there), compared, n."""
    return rows.groupBy(T.shape(parts).alias("shape"), T.compared(expected, got).alias("compared")).agg(F.count("*").alias("n"))


def tag_accuracy(rows: DataFrame, right: Column) -> DataFrame:
    """tag, n, pct: the share right of the synthetic rows (source, notes) that carry each note; an empty note is a tag like any other."""
    tags = F.explode(F.split(F.coalesce("notes", F.lit("")), ";")).alias("tag")
    d = rows.where(F.col("source").startswith("synthetic")).withColumn("_right", right).select(tags, "_right")
    return d.groupBy("tag").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if("_right") / F.count("*"), 3).alias("pct"))


def gate(accuracy: DataFrame, least: float, split: str = "test") -> DataFrame:
    """One row (split, n, pct_core, passed) of ``field_accuracy``; without rows of the split the gate is open."""
    d = accuracy.where((F.col("split") == split) & F.col("source").isNull()).agg(F.max("n").alias("n"), F.max("pct_core").alias("pct_core"))
    return d.select(F.lit(split).alias("split"), F.coalesce("n", F.lit(0)).alias("n"), "pct_core", F.coalesce(F.col("pct_core") >= least, F.lit(True)).alias("passed"))


def require_gate(accuracy: DataFrame, least: float, split: str = "test") -> None:
    r = gate(accuracy, least, split).first()
    if not r["passed"]:
        raise ValueError(f"core accuracy of {split} is {r['pct_core']}, below {least}")


def judgeable(rows: DataFrame, split: str = "all", quality: str = "all") -> DataFrame:
    """The rows with a verified point that an error can be measured on, by split and by quality: oro, plata (any delivery) or all.

    ``lat`` and ``lng`` are text; rows in which either is no number are left out.
    """
    d = rows if split == "all" else rows.where(F.col("split") == split)
    if quality == "oro":
        d = d.where("verification_method = 'gps_entrega_oro'")
    elif quality == "plata":
        d = d.where("startswith(verification_method, 'gps_entrega_')")
    return d.where(F.col("lat").try_cast("double").isNotNull() & F.col("lng").try_cast("double").isNotNull())


def holdout_table(errors: DataFrame) -> DataFrame:
    """method (null: all), n, p50, p75, p90 and the shares within 50, 100 and 150 m of (method, error_m).

    Percentiles are the element at floor(p * (n - 1)) of the sorted errors, found by rank, so no method's errors are gathered.
    """
    both = errors.select("method", "error_m").unionByName(errors.select(F.lit(None).cast("string").alias("method"), "error_m"))
    n = both.groupBy("method", "error_m").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("method").orderBy("error_m").rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("upto", F.sum("k").over(upto)).withColumn("n", F.sum("k").over(Window.partitionBy("method")))
    rank = lambda p: F.min(F.when(F.col("upto") > F.floor(p * (F.col("n") - 1)), F.col("error_m")))
    share = lambda m: F.round(100.0 * F.sum(F.when(F.col("error_m") <= m, F.col("k")).otherwise(0)) / F.sum("k"), 3)
    return n.groupBy("method").agg(F.sum("k").alias("n"), rank(0.5).alias("p50"), rank(0.75).alias("p75"), rank(0.9).alias("p90"), share(50).alias("within_50"), share(100).alias("within_100"), share(150).alias("within_150"))


def markdown(table: DataFrame, title: str, most: int = 1000) -> list[str]:
    """The lines of a report's table: a heading, the header, one line a row; of a small aggregate (more than ``most`` rows is an error)."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows are no report")
    text = lambda v: "—" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v)
    line = lambda cells: f"| {' | '.join(cells)} |"
    return [f"## {title}", "", line(table.columns), line(["---:" if i else "---" for i in range(len(table.columns))]), *(line(map(text, r)) for r in rows), ""]


def imported_labels(rows: DataFrame, reviewer: str, method: str) -> DataFrame:
    """Golden rows from a filled-in labelling sheet: those judged CORRECTO or CORREGIDO.

    Whoever labelled was told to write digits only, so ``S/N`` is restored where the text says so and the proposal had it.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    d = rows.select(*[text(c).alias(c) for c in rows.columns]).where((F.col("id") != "") & F.col("estado").isin("CORRECTO", "CORREGIDO"))
    raw = F.concat_ws(" ", "direccion", F.nullif(F.col("numero"), F.lit("")))
    none = (F.col("num") == "") & (F.col("p_numero") == "S/N") & raw.rlike(r"(?i)\bS\s*/\s*N\b")
    notes = F.concat_ws("; ", F.concat(F.lit("estado="), "estado"), F.when(none, "S/N restaurado"), F.nullif(F.col("comentario"), F.lit("")))
    return d.select(
        F.concat(F.lit("EMS-"), "id").alias("id"), F.lit("emsd_real").alias("source"), raw.alias("raw_address"), F.col("distrito").alias("district_field"), F.col("provincia").alias("province_field"), F.lit("").alias("department_field"),
        F.col("tipo").alias("expected_street_type"), F.col("nombre").alias("expected_street_name"), F.when(none, "S/N").otherwise(F.col("num")).alias("expected_number"), F.col("mz").alias("expected_block"), F.col("lt").alias("expected_lot"),
        F.col("urb").alias("expected_urbanization"), F.col("ubigeo").alias("expected_ubigeo"), F.lit("").alias("lat_verified"), F.lit("").alias("lng_verified"), F.lit(method).alias("verification_method"), F.lit(reviewer).alias("verified_by"),
        F.col("particion").alias("split"), notes.alias("notes"), F.col("interior").alias("expected_interior"),
    )
