"""Queries of evaluation, labelling and streams, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import locate as loc, normalize as norm, review as rev, truth
from ..sources import files
from ..sources.shared import fresh_path
from ..streaming import events
from . import fixtures as X
from .queries import AS_OF, ENTRIES, query, read

# -- evaluation ------------------------------------------------------------------
NOTED = "SELECT *, CASE WHEN row_id % 3 = 0 THEN 'osm' ELSE 'synthetic' || CASE WHEN row_id % 3 = 1 THEN '_mzlt' ELSE '' END END AS src, CASE row_id % 4 WHEN 0 THEN 'a;b' WHEN 1 THEN 'b' WHEN 2 THEN '' ELSE 'c;a;d' END AS notes FROM judged_row"


@query(X.sql("judged_row") + f", j AS ({NOTED}), t AS (SELECT unnest(string_split(notes, ';')) AS tag, exp_ubigeo = got_ubigeo AS ok FROM j WHERE src <> 'osm') SELECT tag, count(*) AS n, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 3) AS pct FROM t GROUP BY tag")
def eval_tags(spark, sf_dir):
    X.view(spark, sf_dir, "judged_row").createOrReplaceTempView("judged_row")
    return rev.tag_accuracy(spark.sql(NOTED).drop("source").withColumnRenamed("src", "source"), F.col("exp_ubigeo") == F.col("got_ubigeo"))


@query(X.sql("judged_row") + "SELECT 'test' AS split, count(*) AS n, round(100.0 * count(*) FILTER (WHERE exp_ubigeo = got_ubigeo AND exp_type = got_type) / count(*), 3) AS pct_core, round(100.0 * count(*) FILTER (WHERE exp_ubigeo = got_ubigeo AND exp_type = got_type) / count(*), 3) >= 95 AS passed FROM judged_row WHERE split = 'test'")
def eval_gate(spark, sf_dir):
    return rev.gate(rev.field_accuracy(X.view(spark, sf_dir, "judged_row"), ("ubigeo", "type")), 95.0)


VERIFIED = "SELECT row_id, split, CASE row_id % 4 WHEN 0 THEN 'gps_entrega_oro' WHEN 1 THEN 'gps_entrega_plata' WHEN 2 THEN 'osm' ELSE '' END AS verification_method, CASE WHEN row_id % 7 = 0 THEN '' WHEN row_id % 7 = 1 THEN 'x' ELSE '-12.1' END AS lat, '-77.0' AS lng FROM judged_row"


@query(X.sql("judged_row") + f", v AS ({VERIFIED}), s AS (SELECT * FROM v WHERE lat = '-12.1') SELECT 'oro' AS quality, row_id FROM s WHERE split = 'dev' AND verification_method = 'gps_entrega_oro' UNION ALL SELECT 'plata', row_id FROM s WHERE verification_method LIKE 'gps%' UNION ALL SELECT 'all', row_id FROM s")
def eval_quality_filter(spark, sf_dir):
    X.view(spark, sf_dir, "judged_row").createOrReplaceTempView("judged_row")
    v = spark.sql(VERIFIED)
    parts = [rev.judgeable(v, split, quality).select(F.lit(quality).alias("quality"), "row_id") for split, quality in (("dev", "oro"), ("all", "plata"), ("all", "all"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


HELD = """, e AS (SELECT precision AS method, error_m FROM judged_row), b AS (SELECT * FROM e UNION ALL SELECT NULL, error_m FROM e), l AS (SELECT method, list_sort(list(error_m)) AS l, count(*) AS n FROM b GROUP BY method)
SELECT method, n, l[floor(0.5 * (n - 1))::INT + 1] AS p50, l[floor(0.75 * (n - 1))::INT + 1] AS p75, l[floor(0.9 * (n - 1))::INT + 1] AS p90, round(100.0 * len(list_filter(l, lambda x: x <= 50)) / n, 3) AS within_50,
round(100.0 * len(list_filter(l, lambda x: x <= 100)) / n, 3) AS within_100, round(100.0 * len(list_filter(l, lambda x: x <= 150)) / n, 3) AS within_150 FROM l"""


@query(X.sql("judged_row") + HELD)
def holdout_percentiles(spark, sf_dir):
    return rev.holdout_table(X.view(spark, sf_dir, "judged_row").select(F.col("precision").alias("method"), "error_m"))


ALONE = X.sql("anchor") + ", request AS (SELECT anchor_id AS req_id, street_id, number AS num FROM anchor WHERE anchor_id % 3 = 0), j AS" + AS_OF.split(", j AS", 1)[1].replace("a.number % 2 = r.num % 2)", "a.number % 2 = r.num % 2 AND a.number <> r.num)", 1)


@query(ALONE + "SELECT req_id, round(CASE c WHEN 1 THEN llng + (num - ln) / (hn - ln) * (hlng - llng) WHEN 2 THEN llng ELSE hlng END, 6) AS lng, CASE c WHEN 1 THEN hn - ln <= 40 AND d <= 250 ELSE false END AS tight FROM k WHERE c IS NOT NULL")
def anchor_holdout_alone(spark, sf_dir):
    """Each number placed by the others of its street and side."""
    a = X.view(spark, sf_dir, "anchor")
    held = a.where("anchor_id % 3 = 0").select(F.col("anchor_id").alias("req_id"), "street_id", F.col("number").alias("num"))
    return loc.interpolate(held, a, hold_out="anchor").select("req_id", F.round("lng", 6).alias("lng"), "tight")


@query(X.sql("judged_row") + ", t AS (SELECT decision, count(*) AS n, round(avg(error_m), 1) AS mean FROM judged_row GROUP BY decision), l AS (SELECT 3 + row_number() OVER (ORDER BY decision) AS no, '| ' || decision || ' | ' || n || ' | ' || printf('%.1f', mean) || ' |' AS line FROM t UNION ALL VALUES (0, '## Decisions'), (1, ''), (2, '| decision | n | mean |'), (3, '| --- | ---: | ---: |'), (100, '')) SELECT (row_number() OVER (ORDER BY no) - 1)::INT AS no, line FROM l")
def report_lines(spark, sf_dir):
    t = X.view(spark, sf_dir, "judged_row").groupBy("decision").agg(F.count("*").alias("n"), F.round(F.avg("error_m"), 1).alias("mean")).orderBy("decision")
    return spark.createDataFrame(list(enumerate(rev.markdown(t, "Decisions"))), "no int, line string")


SHEET = """SELECT CASE WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR(20)) END AS id, CASE c_custkey % 4 WHEN 0 THEN 'CORRECTO' WHEN 1 THEN ' CORREGIDO' WHEN 2 THEN 'DUDOSO' ELSE '' END AS estado, CASE WHEN c_custkey % 3 = 0 THEN 'Av. X s/n' ELSE 'Av. X' END AS direccion,
CASE WHEN c_custkey % 3 = 1 THEN 'S/N' ELSE '' END AS numero, '' AS num, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'S/N' END AS p_numero, CASE WHEN c_custkey % 7 = 0 THEN 'visto' ELSE '' END AS comentario, 'dev' AS particion FROM customer"""


@query(f"""WITH s AS ({SHEET}), k AS (SELECT *, direccion || CASE WHEN numero <> '' THEN ' ' || numero ELSE '' END AS raw FROM s WHERE id <> '' AND trim(estado) IN ('CORRECTO', 'CORREGIDO')), r AS (SELECT *, p_numero = 'S/N' AND upper(raw) LIKE '%S/N%' AS back FROM k)
SELECT 'EMS-' || id AS id, raw AS raw_address, CASE WHEN back THEN 'S/N' ELSE '' END AS expected_number, 'estado=' || trim(estado) || CASE WHEN back THEN '; S/N restaurado' ELSE '' END || CASE WHEN comentario <> '' THEN '; ' || comentario ELSE '' END AS notes, 'ana' AS verified_by, 'dev' AS split FROM r""")
def label_import(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    sheet = spark.sql(SHEET).select("*", *[F.lit(None).cast("string").alias(c) for c in ("distrito", "provincia", "tipo", "nombre", "mz", "lt", "urb", "ubigeo", "interior")])
    return rev.imported_labels(sheet, "ana", "revision_humana").select("id", "raw_address", "expected_number", "notes", "verified_by", "split")


# -- deliveries and samples --------------------------------------------------------
TRACKED = """SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS order_id, CASE event_type WHEN 'purchase' THEN 'EMC' WHEN 'click' THEN 'LPE' ELSE 'OTRO' END AS code, CAST(ts AS TIMESTAMP) AS ts,
CASE WHEN event_id % 11 = 0 THEN 0e0 WHEN event_id % 13 = 0 THEN NULL ELSE -12e0 - (event_id % 100) / 1e4 END AS lat, -77e0 - (event_id % 70) / 1e4 AS lng FROM events"""
ORDERED = f"""SELECT CAST(c_custkey AS BIGINT) AS order_id, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE 'A' END AS state, CASE WHEN c_custkey % 4 = 0 THEN 'LOGISTICA_INVERSA' ELSE 'LOGISTICA_DIRECTA' END AS logistics,
CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'Av. X ' || CAST(c_custkey AS VARCHAR(20)) END AS address, {X.choose('c_custkey', ('150101', '070102', '040110'))} AS ubigeo FROM customer"""


@query(f"""WITH t AS ({TRACKED}), o AS ({ORDERED}), l AS (SELECT * FROM t WHERE code <> 'OTRO' AND lat <> 0 AND lng <> 0 AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY QUALIFY row_number() OVER (PARTITION BY order_id, code ORDER BY ts DESC, event_id DESC) = 1)
SELECT e.order_id, CAST(e.ts AS DATE) AS day, round(e.lat, 6) AS lat, round(e.lng, 6) AS lng, round(a.lat, 6) AS arr_lat, round(a.lng, 6) AS arr_lng, o.ubigeo, o.address
FROM l e JOIN o ON o.order_id = e.order_id LEFT JOIN l a ON a.order_id = e.order_id AND a.code = 'LPE' WHERE e.code = 'EMC' AND state = 'A' AND logistics = 'LOGISTICA_DIRECTA' AND left(ubigeo, 4) IN ('1501', '0701') AND trim(address) <> ''""")
def gps_deliveries(spark, sf_dir):
    for t in ("events", "customer"):
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    return truth.deliveries(spark.sql(TRACKED), spark.sql(ORDERED), F.lit("2024-01-31").cast("timestamp"), 20)


@query(X.sql("request") + "SELECT req_id, CASE req_id % 2 WHEN 0 THEN 'AVENIDA|' ELSE '' END || req_key || '|' || num || '|150116' AS addr_key FROM request WHERE req_id % 3 <> 0")
def gps_address_keys(spark, sf_dir):
    """Deliveries grouped by their normalized address; those whose district is not told take no part."""
    r = X.view(spark, sf_dir, "request")
    text = F.concat(F.when(F.col("req_id") % 2 == 0, "Av. ").otherwise(""), F.col("req_key"), F.lit(" "), F.col("num").cast("string"))
    asked = r.select("req_id", text.alias("address"), F.when(F.col("req_id") % 3 != 0, "Lince").alias("district"))
    return truth.addressed(norm.normalize(asked, ENTRIES, frozenset({"LIMA_METRO"}))).select("req_id", "addr_key")


SHIPPED = """SELECT CAST(o_orderkey AS BIGINT) AS order_id, CAST(o_custkey % 9 AS BIGINT) AS account, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE 'A' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'LOGISTICA_INVERSA' ELSE 'LOGISTICA_DIRECTA' END AS logistics,
CAST(o_orderdate AS TIMESTAMP) AS created_at, 'Av. X ' || CAST(o_custkey AS VARCHAR(20)) || CASE WHEN o_orderkey % 4 = 0 THEN ' tel 987654321' ELSE '' END AS address_to, 'Jr. Y a.b@c.pe ' || CAST(o_custkey % 50 AS VARCHAR(20)) AS address_from,
CASE WHEN o_orderkey % 2 = 0 THEN '10' END AS number_to, '5' AS number_from, '150101' AS ubigeo_to, '150116' AS ubigeo_from FROM orders"""


@query(f"""WITH s AS ({SHIPPED}), l AS (SELECT account, md5(order_id::VARCHAR) AS hash, CASE WHEN logistics = 'LOGISTICA_INVERSA' THEN 'ORIGEN' ELSE 'DESTINO' END AS side, CASE WHEN logistics = 'LOGISTICA_INVERSA' THEN 'Jr. Y <CORREO>' || substr(address_from, 15) ELSE replace(address_to, '987654321', '<NUM>') END AS address,
CASE WHEN logistics = 'LOGISTICA_INVERSA' THEN number_from ELSE number_to END AS number, CASE WHEN logistics = 'LOGISTICA_INVERSA' THEN ubigeo_from ELSE ubigeo_to END AS ubigeo FROM s WHERE state = 'A' AND created_at >= TIMESTAMP '1998-01-01' - INTERVAL 900 DAY),
u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY account, lower(trim(address)), coalesce(number, ''), coalesce(ubigeo, '') ORDER BY hash) = 1), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY account ORDER BY hash) <= 40)
SELECT left(hash, 12) AS sample_id, account, side, address, number, ubigeo FROM k ORDER BY hash LIMIT 200""")
def order_sample(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return rev.order_sample(spark.sql(SHIPPED), F.lit("1998-01-01").cast("timestamp"), 900, 40, 200)


# -- streams ---------------------------------------------------------------------
REQUESTS = "SELECT CAST(user_id % 20 AS VARCHAR(10)) AS client, CAST(event_id % 50 AS VARCHAR(10)) AS key, CAST(event_id AS BIGINT) AS request_id, CAST(ts AS TIMESTAMP) AS time, event_type AS decision, CASE WHEN event_id % 2 = 0 THEN 'STREET' ELSE 'ZONE' END AS precision_level FROM events"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of one file, whose order does not matter."""
    read(spark, sf_dir, "events").createOrReplaceTempView("events")
    rows, path = spark.sql(REQUESTS), fresh_path(spark, "requests")
    rows.coalesce(1).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _written(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now."""
    spark = stream.sparkSession
    path = fresh_path(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/out")).outputMode(mode).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query(f"SELECT client, key FROM ({REQUESTS}) GROUP BY ALL")
def stream_replays(spark, sf_dir):
    """One request of each client and key within a watermark that spans all."""
    return _written(events.replay_protected(_stream(spark, sf_dir), "3650 days")).select("client", "key")


@query(f"SELECT decision, precision_level, count(*) AS n FROM ({REQUESTS}) GROUP BY ALL")
def stream_counters(spark, sf_dir):
    return _written(events.decision_counters(_stream(spark, sf_dir)), "complete")


@query(f"SELECT client, count(*) AS n FROM ({REQUESTS}) GROUP BY ALL")
def stream_event_sink(spark, sf_dir):
    """Events through the sink and read again."""
    path = fresh_path(spark, "events")
    events.event_sink(_stream(spark, sf_dir), f"{path}/out", f"{path}/check", once=True).awaitTermination()
    return spark.read.schema("client string").json(f"{path}/out").groupBy("client").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE r AS (SELECT client, request_id, epoch(date_trunc('hour', time)) AS sec, row_number() OVER (PARTITION BY client ORDER BY date_trunc('hour', time), request_id) AS i FROM ({REQUESTS})),
w(client, i, request_id, sec, tokens, allowed) AS (SELECT client, i, request_id, sec, CAST(1.0 AS DOUBLE), true FROM r WHERE i = 1
UNION ALL SELECT r.client, r.i, r.request_id, r.sec, least(2e0, w.tokens + r.sec - w.sec) - CASE WHEN least(2e0, w.tokens + r.sec - w.sec) >= 1 THEN 1 ELSE 0 END, least(2e0, w.tokens + r.sec - w.sec) >= 1 FROM w JOIN r ON r.client = w.client AND r.i = w.i + 1)
SELECT request_id, allowed FROM w""")
def stream_rate_limit(spark, sf_dir):
    """A bucket of one request a second, two in burst; all requests of an hour come at once."""
    return _written(events.rate_limited(_stream(spark, sf_dir).withColumn("time", F.date_trunc("hour", "time")), 1.0)).select("request_id", "allowed")


@query(f"SELECT time_s AS second, least(n, 1) AS kept, greatest(n - 1, 0) AS dropped FROM (SELECT date_trunc('second', time)::TIMESTAMP AS time_s, count(*) AS n FROM ({REQUESTS}) GROUP BY ALL)")
def buffer_losses(spark, sf_dir):
    read(spark, sf_dir, "events").createOrReplaceTempView("events")
    return events.dropped_events(spark.sql(REQUESTS), 1)


@query(X.sql("request") + "SELECT req_id, CASE WHEN req_id % 2 = 0 THEN 'uno' ELSE 'dos' END AS name, CASE WHEN req_id % 2 = 0 THEN '1' ELSE '2' END AS version FROM request")
def stream_reload(spark, sf_dir):
    """Requests in two micro-batches; between them a new version is published, and a broken one is passed over."""
    r, root = X.view(spark, sf_dir, "request").select("req_id"), fresh_path(spark, "reload")
    table = lambda name: spark.createDataFrame([(name,)], "name string")
    files.publish({"names": table("uno")}, f"{root}/tables", "1")
    for k in (0, 1):
        r.where(F.col("req_id") % 2 == k).coalesce(1).write.parquet(f"{root}/in/part={k}")
        stream = spark.readStream.schema(r.schema).parquet(f"{root}/in/*")
        answer = lambda rows, tables: rows.join(F.broadcast(tables["names"]))
        events.with_latest_tables(stream, lambda: files.latest_version(spark, f"{root}/tables"), answer, lambda rows: rows.write.mode("append").parquet(f"{root}/out"), f"{root}/check", once=True).awaitTermination()
        files.publish({"names": table("dos")}, f"{root}/tables", "2") if k == 0 else None
    return spark.read.parquet(f"{root}/out").select("req_id", "name", "version")
