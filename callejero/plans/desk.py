"""Queries of the review desk, of street placement, of generated test data and of reloads, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..data import lexicon
from ..functions import geo, text as T
from ..operators import desk, gazetteer as gaz, locate as loc, review as rev, synth
from ..sources import files
from . import fixtures as X
from .queries import AS_OF, RING_SQL, SEGMENT, _rings, query

STREET_AXIS = """, x AS (SELECT street_id, (lng0 + lng1) / 2 AS mx, (lat0 + lat1) / 2 AS my, lng0, lat0, lng1, lat1, (lng1 - lng0) * cos(radians((lat0 + lat1) / 2)) * 111194.92664455873 AS dx, (lat1 - lat0) * 111194.92664455873 AS dy FROM street)
"""


def segments(spark, sf_dir):
    return X.view(spark, sf_dir, "street").select("street_id", F.lit(0).alias("line_id"), F.lit(0).alias("seg"), *loc.SEGMENT)


# -- placement -------------------------------------------------------------------
@query(X.sql("anchor") + STREET_AXIS + """, c AS (SELECT s.street_id, a.anchor_id, a.number, a.lng, a.lat, s.lng0, s.lat0, s.lng1, s.lat1 FROM x s JOIN anchor a ON a.street_id <> s.street_id JOIN x o ON o.street_id = a.street_id
WHERE abs(s.dx * o.dx + s.dy * o.dy) >= 0.966 * sqrt(s.dx * s.dx + s.dy * s.dy) * sqrt(o.dx * o.dx + o.dy * o.dy) AND round(abs((a.lng - s.mx) * cos(radians(s.my)) * 111194.92664455873 * s.dx + (a.lat - s.my) * 111194.92664455873 * s.dy) / sqrt(s.dx * s.dx + s.dy * s.dy), 6) <= round(sqrt(s.dx * s.dx + s.dy * s.dy) / 2, 6))""" + SEGMENT.format(cols="*", rows="c") + "SELECT street_id, anchor_id, number, round(lng0 + t * (lng1 - lng0), 5) AS lng, round(lat0 + t * (lat1 - lat0), 5) AS lat FROM seg WHERE metres <= 250")
def parallel_hints(spark, sf_dir):
    h = loc.parallel_hints(segments(spark, sf_dir), X.view(spark, sf_dir, "anchor"))
    return h.select("street_id", "anchor_id", "number", F.round("lng", 5).alias("lng"), F.round("lat", 5).alias("lat"))


@query(AS_OF.replace(" AND a.number % 2 = r.num % 2)", ")", 1) + """SELECT req_id, round(CASE c WHEN 0 THEN elng WHEN 1 THEN llng + (num - ln) / (hn - ln) * (hlng - llng) WHEN 2 THEN llng ELSE hlng END, 6) AS lng, round(CASE c WHEN 0 THEN elat WHEN 1 THEN llat + (num - ln) / (hn - ln) * (hlat - llat) WHEN 2 THEN llat ELSE hlat END, 6) AS lat,
CASE c WHEN 0 THEN 'ADDRESS_POINT' ELSE 'SEGMENT_INTERPOLATED' END AS precision FROM k WHERE c IS NOT NULL""")
def anchor_interpolate_any_side(spark, sf_dir):
    d = loc.interpolate(X.view(spark, sf_dir, "request"), X.view(spark, sf_dir, "anchor"), same_side=False)
    return d.select("req_id", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "precision")


@query(X.sql("anchor") + STREET_AXIS + """, f AS (SELECT a.street_id, a.number, (a.lng - mx) * cos(radians(my)) * 111194.92664455873 AS x, (a.lat - my) * 111194.92664455873 AS y, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy FROM anchor a JOIN x USING (street_id)),
o AS (SELECT street_id, number % 2 AS side, list_sort(list(y * ux - x * uy)) AS l FROM f GROUP BY ALL)
SELECT street_id, side, round(greatest(-40, least(40, l[len(l) // 2 + 1])), 2) + 0e0 AS "offset" FROM o""")
def side_offsets(spark, sf_dir):
    s = segments(spark, sf_dir)
    return loc.side_offsets(X.view(spark, sf_dir, "anchor"), s, loc.frames(s)).withColumn("offset", F.round("offset", 2) + 0.0)


@query(X.sql("street") + f"SELECT street_id, round(lng1, 6) AS lng, round(lat1, 6) AS lat, round({X.distance('lng0', 'lat0', 'lng1', 'lat1')}, 3) AS span FROM street")
def street_middle(spark, sf_dir):
    return loc.middle_points(segments(spark, sf_dir)).select("street_id", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), F.round("span", 3).alias("span"))


# -- desk ------------------------------------------------------------------------
PINS = "SELECT anchor_id AS pin_id, '15' || lpad(CAST(anchor_id % 25 AS VARCHAR(10)), 4, '0') AS ubigeo, CASE WHEN anchor_id % 8 = 0 THEN NULL WHEN anchor_id % 9 = 0 THEN CAST(-1 AS BIGINT) ELSE street_id END AS street_id, lng, lat FROM anchor"


@query(X.sql("anchor") + RING_SQL + f""", p AS ({PINS}){SEGMENT.format(cols="pin_id", rows="(SELECT pin_id, lng, lat, s.lng0, s.lat0, s.lng1, s.lat1 FROM p JOIN street s USING (street_id))")}
SELECT p.pin_id, concat_ws(' ', CASE WHEN i.ubigeo IS NULL THEN 'PIN_OUTSIDE_DISTRICT' END, CASE WHEN p.street_id IS NOT NULL AND coalesce(metres, 1e9) > 100 THEN 'PIN_FAR_FROM_STREET' END) AS alerts
FROM p LEFT JOIN inside i ON i.anchor_id = p.pin_id AND i.ubigeo = p.ubigeo LEFT JOIN seg ON seg.pin_id = p.pin_id""")
def pin_alerts(spark, sf_dir):
    X.view(spark, sf_dir, "anchor").createOrReplaceTempView("anchor")
    return desk.pin_alerts(spark.sql(PINS), geo.edges(_rings(spark, sf_dir)), segments(spark, sf_dir)).withColumn("alerts", F.array_join("alerts", " "))


EDITS = "SELECT anchor_id AS edit_id, CASE WHEN anchor_id % 2 = 0 THEN 'mark' ELSE 'anchor' END AS kind, CASE WHEN anchor_id % 19 = 0 THEN CAST(-1 AS BIGINT) ELSE street_id END AS street_id, CASE WHEN anchor_id % 17 = 0 THEN number * 1000 WHEN anchor_id % 23 = 0 THEN 0 ELSE number END AS value, lng, lat FROM anchor"


@query(X.sql("anchor") + f""", e AS ({EDITS}){SEGMENT.format(cols="edit_id", rows="(SELECT edit_id, lng, lat, s.lng0, s.lat0, s.lng1, s.lat1 FROM e JOIN street s USING (street_id))")}
SELECT e.edit_id, CASE WHEN NOT (CASE kind WHEN 'mark' THEN value BETWEEN 0 AND 999 ELSE value BETWEEN 1 AND 99999 END) THEN 'VALUE_OUT_OF_RANGE' WHEN metres IS NULL THEN 'UNKNOWN_STREET' WHEN metres > 60 THEN 'FAR_FROM_STREET' ELSE '' END AS error FROM e LEFT JOIN seg USING (edit_id)""")
def edit_validation(spark, sf_dir):
    X.view(spark, sf_dir, "anchor").createOrReplaceTempView("anchor")
    return desk.edit_errors(spark.sql(EDITS), segments(spark, sf_dir))


@query(X.sql("anchor") + """, m AS (SELECT street_id, number, anchor_id FROM anchor WHERE anchor_id % 3 = 0 AND anchor_id % 6 <> 0), p AS (SELECT street_id, number, anchor_id FROM anchor WHERE anchor_id % 3 = 1)
SELECT street_id, number, 'manual:' || anchor_id AS ref FROM m UNION ALL SELECT street_id, number, 'pin:' || anchor_id FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.street_id = p.street_id AND m.number = p.number)""")
def street_edits(spark, sf_dir):
    a = X.view(spark, sf_dir, "anchor")
    manual = a.where("anchor_id % 3 = 0").withColumnRenamed("anchor_id", "edit_id").drop("deleted_at")
    gone = manual.where("edit_id % 6 = 0").select("edit_id", F.explode(F.array(F.lit(5), F.lit(3))).alias("at"))
    return desk.street_edits(desk.soft_deleted(manual, gone), a.where("anchor_id % 3 = 1").withColumnRenamed("anchor_id", "pin_id")).select("street_id", "number", "ref")


ACTIONS = """SELECT address_key AS ticket_id, event_id AS action_id, created_at AS acted_at, operator AS actor, CASE event_id % 7 WHEN 0 THEN 'pin' WHEN 1 THEN 'unresolvable' WHEN 2 THEN 'shrug' ELSE 'escalate' END AS action,
CASE WHEN event_id % 3 = 0 THEN NULL ELSE -77.0e0 END AS lng, -12.0e0 AS lat, street_id, CASE WHEN event_id % 2 = 0 THEN 'sin acceso' ELSE '' END AS note FROM ticket_event"""
OPEN = "SELECT DISTINCT address_key AS ticket_id, CASE WHEN address_key % 11 = 0 THEN 'resolved' ELSE 'open' END AS status, 'CALLE|' || CAST(address_key AS VARCHAR(20)) AS address_key, 'Los Sauces' AS street_name FROM ticket_event"
JUDGED = X.sql("ticket_event") + f""", a AS ({ACTIONS}), t AS ({OPEN}), v AS (SELECT a.*, status, CASE WHEN action NOT IN ('pin', 'unresolvable', 'escalate') THEN 'UNKNOWN_ACTION' WHEN action = 'pin' AND lng IS NULL THEN 'PIN_WITHOUT_POINT' WHEN action = 'unresolvable' AND note = '' THEN 'NO_REASON' ELSE '' END AS e FROM a JOIN t USING (ticket_id)),
c AS (SELECT *, status = 'resolved' OR coalesce(bool_or(e = '' AND action IN ('pin', 'unresolvable')) OVER (PARTITION BY ticket_id ORDER BY acted_at, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM v),
j AS (SELECT *, CASE WHEN closed THEN 'CLOSED' ELSE e END AS error, CASE WHEN NOT closed AND e = '' THEN CASE action WHEN 'pin' THEN 'resolved' WHEN 'unresolvable' THEN 'unresolvable' ELSE 'escalated' END END AS new_status FROM c)
"""


def _judged(spark, sf_dir):
    X.view(spark, sf_dir, "ticket_event").createOrReplaceTempView("ticket_event")
    tickets = spark.sql(OPEN)
    return desk.judged_actions(spark.sql(ACTIONS).withColumnRenamed("acted_at", "at"), tickets), tickets


@query(JUDGED + "SELECT action_id, error, new_status FROM j")
def ticket_resolution(spark, sf_dir):
    return _judged(spark, sf_dir)[0].select("action_id", "error", "new_status")


@query(JUDGED + "SELECT ticket_id, action_id, coalesce(lag(new_status) OVER (PARTITION BY ticket_id ORDER BY acted_at, action_id), status) AS before, new_status AS after FROM j WHERE error = ''")
def ticket_audit(spark, sf_dir):
    return desk.audit_trail(*_judged(spark, sf_dir)).select("ticket_id", "action_id", "before", "after")


@query(JUDGED + "SELECT sha256('CALLE|' || ticket_id) AS address_hash, 'ticket:' || ticket_id AS source_ref, actor AS author FROM j WHERE error = '' AND action = 'pin'")
def pin_observations(spark, sf_dir):
    return desk.observations(*_judged(spark, sf_dir)).select("address_hash", "source_ref", "author")


DETAIL = """SELECT s_suppkey AS ticket_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 'broken' ELSE '{"candidates":[{"street_id":' || CAST(s_suppkey AS VARCHAR(20)) || '},{"street_id":' || CAST(s_suppkey + 1 AS VARCHAR(20)) || '}]}' END AS candidates, '150116' AS ubigeo FROM supplier"""


@query(X.sql("street") + f""", d AS ({DETAIL}), c AS (SELECT ticket_id, unnest([ticket_id, ticket_id + 1]) AS street_id FROM d WHERE candidates LIKE '{{%'), n AS (SELECT ticket_id, count(*)::INT AS n_streets, string_agg(trim(type || ' ' || name), ',' ORDER BY street_id) AS names FROM c JOIN street USING (street_id) GROUP BY ticket_id)
SELECT ticket_id, 'LINCE' AS district, coalesce(n_streets, 0)::INT AS n_streets, coalesce(names, '') AS names FROM d LEFT JOIN n USING (ticket_id)""")
def ticket_detail(spark, sf_dir):
    s = X.view(spark, sf_dir, "street")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("supplier")
    point = lambda i: F.struct(F.col(f"lng{i}").alias("lng"), F.col(f"lat{i}").alias("lat"))
    districts = spark.createDataFrame([("150116", "LINCE", "{}")], "ubigeo string, district string, polygon string")
    d = desk.ticket_details(spark.sql(DETAIL), districts, s, s.select("street_id", F.array(F.array(point(0), point(1))).alias("lines")))
    names = F.from_json("streets_geojson", "features array<struct<properties: struct<name: string>>>")["features"]["properties"]["name"]
    return d.select("ticket_id", "district", "n_streets", F.array_join(names, ",").alias("names"))


@query("SELECT coalesce(n.k, o.k) AS ubigeo, coalesce(n.d, o.d) AS district, coalesce(n.p, o.p) AS polygon FROM (SELECT n_nationkey AS k, n_name AS d, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'old' END AS p FROM nation WHERE n_nationkey < 20) o FULL JOIN (SELECT n_nationkey AS k, lower(n_name) AS d, CASE WHEN n_nationkey % 2 = 0 THEN 'new' END AS p FROM nation WHERE n_nationkey >= 10) n ON o.k = n.k")
def district_load(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    old = n.where("n_nationkey < 20").select(k.alias("ubigeo"), F.col("n_name").alias("district"), F.when(k % 3 != 0, "old").alias("polygon"))
    return desk.loaded_districts(old, n.where("n_nationkey >= 10").select(k.alias("ubigeo"), F.lower("n_name").alias("district"), F.when(k % 2 == 0, "new").alias("polygon")))


@query(X.sql("street", "ticket_event") + "SELECT street_id, 'live' AS state FROM street WHERE street_id % 3 <> 0 UNION ALL SELECT street_id, 'referenced' FROM street WHERE street_id % 3 = 0 AND street_id IN (SELECT street_id FROM ticket_event WHERE street_id IS NOT NULL)")
def street_reload(spark, sf_dir):
    s = X.view(spark, sf_dir, "street").select("street_id", "name")
    return desk.reloaded_streets(s, s.where("street_id % 3 <> 0"), X.view(spark, sf_dir, "ticket_event")).select("street_id", "state")


@query("SELECT c_custkey AS req_id FROM customer WHERE c_custkey % 7 < 3")
def api_key_check(spark, sf_dir):
    key = F.concat(F.lit("key-"), (F.col("c_custkey") % 7).cast("string"))
    keys = spark.range(5).select(F.sha2(F.concat(F.lit("key-"), F.col("id").cast("string")), 256).alias("key_hash"), (F.col("id") >= 3).alias("revoked"))
    return desk.authorized(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("req_id"), key.alias("api_key")), keys)


@query("SELECT o_custkey AS batch_id, count(*) AS n, CASE WHEN count(*) > 15 THEN 'TOO_MANY' WHEN sum(strlen(o_orderpriority)) > 120 THEN 'TOO_LARGE' ELSE '' END AS error FROM orders GROUP BY o_custkey")
def batch_limits(spark, sf_dir):
    return desk.batch_errors(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderpriority").alias("address")), 15, 120)


@query("SELECT o_orderkey AS ticket_id, 'resolved' AS status, o_orderkey % 90 + 0.5e0 AS lat, CAST(NULL AS DOUBLE) AS lng, 'x' AS note, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS resolved_at FROM orders WHERE o_orderstatus = 'F'")
def verified_export(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t = o.select(F.col("o_orderkey").alias("ticket_id"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status"), F.to_json(F.struct((F.col("o_orderkey") % 90 + 0.5).alias("lat"), F.lit("x").alias("note"))).alias("resolution"), F.col("o_orderdate").alias("resolved_at"))
    return desk.verified_export(t)


# -- gazetteer -------------------------------------------------------------------
@query(X.sql("street") + "SELECT street_id, ubigeo, a.alias FROM street a WHERE a.alias <> '' AND NOT EXISTS (SELECT 1 FROM street b WHERE b.ubigeo = a.ubigeo AND b.key = a.alias)")
def free_aliases(spark, sf_dir):
    return gaz.free_aliases(X.view(spark, sf_dir, "street").where("alias <> ''").withColumn("aliases", F.array("alias")))


@query(X.sql("request") + "SELECT ubigeo, req_key AS key, min(req_id) AS area_id FROM request GROUP BY ubigeo, req_key")
def area_first(spark, sf_dir):
    a = X.view(spark, sf_dir, "request").select("ubigeo", F.col("req_id").alias("area_id"), F.concat(F.when(F.col("req_id") % 2 == 0, "Urbanización ").otherwise("SECTOR "), F.initcap("req_key")).alias("name"))
    return gaz.first_areas(a).select("ubigeo", "key", "area_id")


@query(X.sql("street") + "SELECT ubigeo, type, key, count(*)::INT AS n_lines, string_agg(street_id::VARCHAR, ',' ORDER BY street_id::VARCHAR) AS refs FROM street WHERE street_id % 4 <> 0 AND street_id % 5 <> 0 GROUP BY ubigeo, type, key")
def street_groups(spark, sf_dir):
    s = X.view(spark, sf_dir, "street")
    point = lambda i: F.struct(F.col(f"lng{i}").alias("lng"), F.col(f"lat{i}").alias("lat"))
    tags = F.create_map(F.lit("name"), F.when(F.col("street_id") % 5 == 0, "").otherwise(F.col("name")), F.lit("highway"), F.when(F.col("street_id") % 4 == 0, "footway").otherwise("residential"))
    w = s.select("ubigeo", "type", "name", F.col("street_id").cast("string").alias("ref"), F.array(point(0), point(1)).alias("points"), tags.alias("tags"), F.array("alias").alias("aliases"))
    return gaz.grouped_streets(gaz.named_ways(w)).select("ubigeo", "type", "key", F.size("lines").alias("n_lines"), F.array_join("refs", ",").alias("refs"))


@query(X.sql("street") + "SELECT street_id, printf('MULTILINESTRING((%.6f %.6f,%.6f %.6f))', lng0, lat0, lng1, lat1) AS wkt FROM street")
def wkt_lines(spark, sf_dir):
    point = lambda i: F.struct(F.col(f"lng{i}").alias("lng"), F.col(f"lat{i}").alias("lat"))
    return X.view(spark, sf_dir, "street").select("street_id", files.wkt_lines(F.array(F.array(point(0), point(1)))).alias("wkt"))


# -- generated data --------------------------------------------------------------
def draw(ident: str, tag: str, n: int) -> str:
    return f"(('0x' || substr(md5('1|{tag}|' || {ident}), 1, 8))::BIGINT % {n})"


def one_of(ident: str, tag: str, values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{draw(ident, tag, len(values))} + 1]"


def forms(by: str, table: dict[str, tuple[str, ...]], ident: str, tag: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN '{k}' THEN {one_of(ident, tag, v)}" for k, v in table.items()) + " ELSE '' END"


PLACED = f"""p AS (SELECT *, {draw('id', 'place', 7)} AS mode, {draw('id', 'case', 10)} AS up, {draw('id', 'accents', 2)} AS bare FROM a),
q AS (SELECT *, addr || CASE mode WHEN 1 THEN ', Breña' WHEN 2 THEN ' - Breña' WHEN 3 THEN ', Breña, Lima' WHEN 4 THEN ', Breña, Lima, Perú' WHEN 5 THEN ' Breña' WHEN 6 THEN ' - Breña' ELSE '' END AS raw, CASE mode WHEN 6 THEN 'Lima' ELSE '' END AS province_field FROM p),
z AS (SELECT *, CASE WHEN up < 2 THEN upper(raw) WHEN up = 2 THEN lower(raw) ELSE raw END AS cased FROM q),
noise AS (SELECT *, CASE WHEN bare = 0 THEN translate(cased, 'áéíóúÁÉÍÓÚ', 'aeiouAEIOU') ELSE cased END AS raw_address FROM z)
"""
TITLED = "CASE (c_custkey) % 3 WHEN 0 THEN 'MARISCAL CASTILLA' WHEN 1 THEN 'SANTA ROSA' ELSE 'LOS SAUCES' END"
SHORT = "CASE (c_custkey) % 3 WHEN 0 THEN 'Mcal. CASTILLA' WHEN 1 THEN 'Sta. ROSA' ELSE 'LOS SAUCES' END"
KIND = X.choose("c_custkey", (*lexicon.DEFAULT.street_types, ""))


@query(f"""WITH k AS (SELECT c_custkey AS id, {KIND} AS type, CASE WHEN {draw('c_custkey', 'titles', 2)} = 0 THEN {SHORT} ELSE {TITLED} END AS name, c_custkey % 900 + 1 AS number FROM customer),
l AS (SELECT *, CASE WHEN {draw('id', 'untyped', 100)} < 8 OR type = '' THEN '' ELSE {forms('type', synth.TYPE_FORMS, 'id', 'type')} END AS kind FROM k),
a AS (SELECT id, CASE WHEN kind = '' THEN '' WHEN suffix(kind, '.') AND {draw('id', 'glued', 5)} = 0 THEN kind ELSE kind || ' ' END || name || ' ' || {one_of('id', 'number', synth.NUMBER_FORMS)} || number || CASE WHEN {draw('id', 'inner', 100)} < 15 THEN ' ' || {one_of('id', 'interior', synth.INTERIORS)} ELSE '' END AS addr, CASE WHEN {draw('id', 'untyped', 100)} < 8 THEN '' ELSE type END AS expected_type FROM l),
{PLACED} SELECT id, raw_address, province_field, expected_type FROM noise""")
def noisy_addresses(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    p = spark.sql(f"SELECT c_custkey AS id, {KIND} AS type, {TITLED} AS name, CAST(c_custkey % 900 + 1 AS STRING) AS number, 'Breña' AS district, 'Lima' AS province, 'Perú' AS department FROM customer")
    return synth.noisy(p).select("id", "raw_address", "province_field", "expected_type")


@query(f"""WITH k AS (SELECT 'MZL-' || s_suppkey || '-' || v AS id, CASE s_suppkey % 3 WHEN 0 THEN 'URBANIZACION' WHEN 1 THEN 'COOPERATIVA' ELSE 'ASENTAMIENTO HUMANO' END AS marker FROM supplier, (SELECT unnest([1, 2]) AS v)),
l AS (SELECT *, CASE WHEN {draw('id', 'block', 100)} < 75 THEN chr((65 + {draw('id', 'letter', 26)})::INT) WHEN {draw('id', 'block', 100)} < 88 THEN chr((65 + {draw('id', 'letter', 26)})::INT) || ({draw('id', 'digit', 3)} + 1) ELSE '' || ({draw('id', 'count', 60)} + 1) END AS block, ({draw('id', 'lot', 40)} + 1) || CASE WHEN {draw('id', 'lettered', 8)} = 0 THEN chr((65 + {draw('id', 'lot letter', 4)})::INT) ELSE '' END AS lot FROM k),
m AS (SELECT *, {one_of('id', 'mz', synth.BLOCK_FORMS)} || block || ' ' || {one_of('id', 'lt', synth.LOT_FORMS)} || lot AS u, {forms('marker', synth.MARKERS, 'id', 'marker')} || ' Los Álamos' AS urb FROM l),
a AS (SELECT *, CASE {draw('id', 'order', 4)} WHEN 0 THEN u || ' ' || urb WHEN 1 THEN urb || ' ' || u WHEN 2 THEN 'Calle 5 ' || u || ' ' || urb ELSE urb || ' Calle 5 ' || u END AS addr FROM m),
{PLACED} SELECT id, raw_address, block, lot FROM noise""")
def noisy_lots(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey") % 3
    marker = F.when(k == 0, "URBANIZACION").when(k == 1, "COOPERATIVA").otherwise("ASENTAMIENTO HUMANO")
    a = s.select(F.col("s_suppkey").alias("area_id"), marker.alias("marker"), F.lit("Los Álamos").alias("name"), F.lit("Breña").alias("district"), F.lit("Lima").alias("province"), F.lit("Perú").alias("department"))
    return synth.noisy_lots(a).select("id", "raw_address", "block", "lot")


POINTS = "SELECT p_partkey AS point_id, CASE p_partkey % 4 WHEN 0 THEN 'Av.' ELSE 'CALLE' END AS type, CASE p_partkey % 3 WHEN 0 THEN 'Los Sauces' ELSE 'LOS SAUCES' END AS name, CASE p_partkey % 7 WHEN 0 THEN '12-14' WHEN 1 THEN '0' WHEN 2 THEN '15 b' ELSE CAST(p_partkey % 50 + 1 AS VARCHAR(10)) END AS number, CAST(p_partkey % 6 AS INT) % 5 AS n_districts FROM part"


@query(f"""WITH p AS ({POINTS}), w AS (SELECT *, CASE WHEN type = 'Av.' THEN 'tipo_abreviado' WHEN number IN ('12-14', '0') THEN 'numero_no_simple' WHEN n_districts <> 1 THEN 'distrito_no_unico' ELSE '' END AS reason FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY type, upper(name), upper(number), reason ORDER BY point_id) AS k FROM w) SELECT point_id, CASE WHEN reason = '' AND k > 1 THEN 'repetido' ELSE reason END AS reason FROM n""")
def point_cleaning(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return synth.clean_points(spark.sql(POINTS))


#: Names of areas as maps have them, the catalog's place names, and names of districts by code.
AREA_NAMES = (
    "Urb. Los Álamos", "Urb.Los Olivos", "AA.HH. Nueva Vida", "Asentamiento Humano Señor de los Milagros", "Sector Lote 5", "Breña", "Unidad La Perla", "Villa Tercera Etapa", "Zona 3ra (alta)",
    "Residencial 2da Quinta Heren", "Parque Central", "Grupo", "Conjunto de La Perla", "Pueblo Joven A. H. Unidos", "urbanización los  álamos",
)
PLACES = ("BRENA", "LIMA", "LA PERLA", "CALLAO")
OWN_NAMES = (("070104", "LA PERLA"), ("070104", "PERLA ALTA"), ("150105", "BRENA"), ("150105", "HEREN"))
AREAS = f"SELECT c_custkey AS area_id, {X.choose('c_custkey', AREA_NAMES)} || CASE WHEN c_custkey % 4 = 1 THEN ' ' || CAST(c_custkey % 90 AS VARCHAR(10)) ELSE '' END AS name, CASE floor(c_custkey / 15) % 2 WHEN 0 THEN '070104' ELSE '150105' END AS ubigeo, CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 1 END AS n_districts FROM customer"
_listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_cases = lambda of, pairs: f"CASE {of} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


@query(f"""WITH d AS (SELECT *, trim(regexp_replace(regexp_replace({X.folded('name', True)}, '[^A-Z0-9Ñ ]', ' ', 'g'), '\\s+', ' ', 'g')) AS shown, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS written FROM ({AREAS})),
e AS (SELECT *, regexp_extract(translate(shown, 'Ñ', 'N'), '^({'|'.join(lexicon.DEFAULT.area_markers)}) ', 1) AS opened FROM d),
f AS (SELECT *, substr(shown, CASE opened WHEN '' THEN 1 ELSE length(opened) + 2 END) AS rest, coalesce({_cases('opened', lexicon.DEFAULT.area_markers)}, 'URBANIZACION') AS marker,
 array_to_string(string_split(written, ' ')[CASE opened WHEN '' THEN 1 ELSE len(string_split(opened, ' ')) + 1 END:], ' ') AS kept FROM e),
g AS (SELECT *, string_split(rest, ' ') AS w, translate(rest, 'Ñ', 'N') AS key, string_split(translate(rest, 'Ñ', 'N'), ' ') AS k FROM f),
o AS (SELECT g.area_id, bool_or(len(list_filter(range(2, len(k) + 1), lambda j: k[j - 1] NOT IN ('DE', 'DEL', 'LA', 'LAS', 'LOS', 'EL', 'Y') AND starts_with(array_to_string(k[j:], ' ') || ' ', v.n || ' '))) > 0) AS own
 FROM g LEFT JOIN (VALUES {', '.join(map(str, OWN_NAMES))}) v(u, n) ON v.u = g.ubigeo GROUP BY g.area_id),
h AS (SELECT area_id, ubigeo, marker, kept AS name, marker || ' ' || array_to_string(list_transform(w, lambda x, i: CASE WHEN regexp_matches(x, '^[0-9]+({lexicon.ORDINAL_ENDINGS.replace(' ', '|')})$') THEN regexp_extract(x, '^[0-9]+')
  WHEN w[i + 1] IN ('ETAPA', 'SECTOR', 'ZONA', 'GRUPO') THEN coalesce({_cases('x', lexicon.DEFAULT.ordinal_words)}, x) ELSE x END), ' ') AS expected,
 CASE WHEN len(string_split(written, ' ')) <> len(string_split(shown, ' ')) OR written LIKE '%(%' OR written LIKE '%)%' OR ' ' || shown || ' ' LIKE '% A H %' THEN 'puntuacion_ambigua'
  WHEN list_has_any(k, {_listed([*lexicon.DEFAULT.words_not_in_area_names, *lexicon.DEFAULT.reference_markers, *lexicon.DEFAULT.street_types])}) THEN 'palabra_que_cambia_el_parseo'
  WHEN key IN {PLACES} THEN 'nombre_de_distrito' WHEN n_districts <> 1 THEN 'fuera_o_en_borde' WHEN own THEN 'nombre_con_su_distrito' ELSE '' END AS reason FROM g JOIN o USING (area_id))
SELECT area_id, CASE reason WHEN '' THEN marker END AS marker, CASE reason WHEN '' THEN name END AS name, CASE reason WHEN '' THEN expected END AS expected, CASE WHEN reason = '' AND row_number() OVER (PARTITION BY ubigeo, expected, reason ORDER BY area_id) > 1 THEN 'duplicado' ELSE reason END AS reason FROM h""")
def area_cleaning(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    names, own = spark.createDataFrame([(p,) for p in PLACES], "key string"), spark.createDataFrame(list(OWN_NAMES), "ubigeo string, key string")
    return synth.clean_areas(spark.sql(AREAS), names, own)


@query(X.sql("request") + "SELECT req_id FROM (SELECT req_id, row_number() OVER (PARTITION BY ubigeo ORDER BY md5('1|' || req_id)) AS k FROM request) WHERE k <= 15")
def area_sample(spark, sf_dir):
    return synth.sampled_areas(X.view(spark, sf_dir, "request").withColumnRenamed("req_id", "area_id")).select(F.col("area_id").alias("req_id"))


@query("WITH l AS (SELECT o_orderkey AS id, CAST(o_custkey % 23 AS VARCHAR) AS account, row_number() OVER (PARTITION BY o_custkey % 23 ORDER BY o_orderstatus, md5(CAST(o_orderkey AS VARCHAR))) - 1 AS level FROM orders) SELECT id FROM l ORDER BY level >= 8, level, md5(account) LIMIT 200")
def round_robin(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 23).cast("string").alias("account"), "o_orderstatus")
    return synth.round_robin(o, "account", [F.col("o_orderstatus"), F.md5(F.col("id").cast("string"))]).select("id")


# -- text and evaluation ---------------------------------------------------------
@query(X.sql("request") + """, w AS (SELECT req_id, string_split(lower('De ' || req_key || ' de las Flores'), ' ') AS l, req_key FROM request)
SELECT req_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i > 1 AND l[i] IN ('de', 'del', 'la', 'las', 'los', 'el') THEN l[i] ELSE upper(l[i][1]) || l[i][2:] END), ' ') AS title, 'Canon ' || req_key AS bare FROM w""")
def text_title(spark, sf_dir):
    r = X.view(spark, sf_dir, "request")
    return r.select("req_id", T.title_case(F.concat(F.lit("De "), "req_key", F.lit(" de las Flores"))).alias("title"), T.strip_accents(F.concat(F.lit("Cánon "), "req_key")).alias("bare"))


@query(X.sql("judged_row") + "SELECT concat_ws(' + ', CASE WHEN got_ubigeo <> '' THEN 'distrito' END, CASE WHEN got_type <> 'X' THEN 'via' END) AS shape, CASE WHEN exp_ubigeo = got_ubigeo THEN 'igual' WHEN got_ubigeo = '' THEN 'abstencion' ELSE 'distinto' END AS compared, count(*) AS n FROM judged_row GROUP BY ALL")
def sample_profile(spark, sf_dir):
    j = X.view(spark, sf_dir, "judged_row")
    return rev.profile(j, {"distrito": F.col("got_ubigeo"), "via": F.nullif(F.col("got_type"), F.lit("X"))}, F.col("exp_ubigeo"), F.col("got_ubigeo"))
