"""Address inputs derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import ACCENTED, PHONETIC, PLAIN

NAMES = ("LOS SAUCES", "LAS PALMERAS", "SAN MARTIN", "GENERAL VIVANCO", "LOS NARANJOS", "2 DE MAYO", "QUEZADA CHAVEZ", "VILLA LLANOS")
ASKED = (*NAMES, "LOS SAUCEZ", "PALMERAS", "SAN MARTYN", "INVENTADO")


def choose(by: str, values: tuple[str, ...]) -> str:
    return f"CASE ({by}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


UBIGEO = ("150101", "150116", "150122")
TYPES = ("CALLE", "AVENIDA", "")

VIEWS = {
    "suppliers": "SELECT count(*) AS n_suppliers FROM supplier",
    "street": f"""SELECT CAST(s_suppkey AS BIGINT) AS street_id, {choose('s_suppkey', UBIGEO)} AS ubigeo, {choose('s_suppkey', TYPES)} AS type, {choose('s_suppkey', NAMES)} AS name,
  {choose('s_suppkey', NAMES)} AS key, CASE WHEN s_suppkey % 5 = 0 THEN 'LOS SAUCE' WHEN s_suppkey % 7 = 0 THEN 'VIA VIEJA' ELSE '' END AS alias, s_suppkey % 14 = 0 AS promoted,
  -77.05e0 + (s_suppkey % 40) * 5e-4 AS lng0, -12.0e0 - floor(s_suppkey / 40) * 5e-4 AS lat0, -77.047e0 + (s_suppkey % 40) * 5e-4 AS lng1, -12.0e0 - floor(s_suppkey / 40) * 5e-4 + (s_suppkey % 5) * 2e-4 AS lat1 FROM supplier""",
    "anchor": """SELECT CAST(p_partkey AS BIGINT) AS anchor_id, street_id, ubigeo, CAST(100 * (floor(p_partkey / 7) % 9) + (p_partkey * 13) % 100 + 1 AS INT) AS number,
  lng0 + (100 * (floor(p_partkey / 7) % 9) + (p_partkey * 13) % 100) / 9e2 * (lng1 - lng0) + CASE WHEN p_partkey % 13 = 0 THEN 3e-3 ELSE (p_partkey % 11) * 1e-5 END AS lng,
  lat0 + (100 * (floor(p_partkey / 7) % 9) + (p_partkey * 13) % 100) / 9e2 * (lat1 - lat0) + (p_partkey % 3) * 1e-5 AS lat
  FROM part CROSS JOIN suppliers JOIN street ON p_partkey % n_suppliers = street_id % n_suppliers""",
    "request": f"""SELECT CAST(c_custkey AS BIGINT) AS req_id, {choose('c_custkey', UBIGEO)} AS ubigeo, {choose('c_custkey', TYPES)} AS req_type, {choose('c_custkey', ASKED)} AS req_key,
  CAST((c_custkey * 37) % 1000 + 1 AS INT) AS num, CAST(c_custkey % n_suppliers AS BIGINT) AS street_id FROM customer CROSS JOIN suppliers""",
    "delivery": """SELECT CAST(event_id AS BIGINT) AS delivery_id, CAST(user_id AS BIGINT) AS addr_key, CAST(ts AS DATE) AS day,
  -77.03e0 + (user_id % 50) * 4e-4 + (event_id % 7) * 3e-5 AS lng, -12.08e0 + (event_id % 5) * 2e-5 AS lat,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE -77.03e0 + (user_id % 50) * 4e-4 + (event_id % 7) * 3e-5 + (event_id % 4) * 2e-4 * (event_id % 6) / 5 + (event_id % 2) * 5e-5 END AS arr_lng,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE -12.08e0 + (event_id % 5) * 2e-5 END AS arr_lat, user_id % 50 <> 49 AS in_district FROM events""",
    "ticket_event": """SELECT CAST(o_custkey AS BIGINT) AS address_key, CAST(o_orderkey AS BIGINT) AS event_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS BIGINT) END AS street_id,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'escalated' ELSE 'resolved' END AS status, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 'OPERATOR_PIN' ELSE 'GPS' END AS method,
  CASE WHEN o_orderkey % 4 = 0 THEN 'plata' ELSE 'oro' END AS quality, 'op' || CAST(o_orderkey % 5 AS VARCHAR(10)) AS operator FROM orders""",
    "judged_row": f"""SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_id, {choose('l_orderkey', ('AUTO_ACCEPT', 'ACCEPT_FLAGGED', 'REVIEW'))} AS decision, {choose('l_partkey', ('ADDRESS_POINT', 'SEGMENT_INTERPOLATED', 'STREET', 'ZONE', 'DISTRICT'))} AS precision,
  {choose('l_suppkey', ('osm', 'gps'))} AS source, CASE WHEN l_orderkey % 10 < 3 THEN 'test' ELSE 'dev' END AS split, CAST((l_partkey * 7 + l_orderkey) % 400 AS DOUBLE) AS error_m,
  {choose('l_partkey', UBIGEO)} AS exp_ubigeo, CASE WHEN l_orderkey % 8 = 0 THEN '' ELSE {choose('l_partkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END', UBIGEO)} END AS got_ubigeo,
  l_returnflag AS exp_type, CASE WHEN l_linenumber = 3 THEN 'X' ELSE l_returnflag END AS got_type FROM lineitem""",
}
NEEDS = {"anchor": ("suppliers", "street"), "request": ("suppliers",)}


def sql(*names: str) -> str:
    """A WITH clause of these views."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n"


#: As the view's SQL, with the number that the two sides share as a column of each: Spark joins on columns, and else compares all pairs.
MATCHED = "FROM part CROSS JOIN suppliers JOIN street ON p_partkey % n_suppliers = street_id % n_suppliers"
JOINED = "FROM (SELECT p_partkey, p_partkey % n_suppliers AS part_slot FROM part CROSS JOIN suppliers) JOIN (SELECT street.*, street_id % n_suppliers AS street_slot FROM street CROSS JOIN suppliers) ON part_slot = street_slot"

TABLES = ("supplier", "part", "customer", "events", "orders", "lineitem")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = sql(name).replace(MATCHED, JOINED) + f"SELECT * FROM {name}"
    args = {}
    for t in TABLES:
        if t in VIEWS[name] or any(t in VIEWS[n] for n in NEEDS.get(name, ())):
            args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            args[t].createOrReplaceTempView(t)
    return spark.sql(text)


# -- expressions of the oracles, in DuckDB's SQL ---------------------------------
def distance(a: str, b: str, c: str, d: str) -> str:
    return f"(6371000.0 * sqrt(pow(radians({c} - {a}) * cos(radians(({b} + {d}) / 2)), 2) + pow(radians({d} - {b}), 2)))"


def folded(x: str, keep: bool = False) -> str:
    return f"regexp_replace(translate(upper({x}), '{ACCENTED}{'' if keep else 'Ñ'}', '{PLAIN}{'' if keep else 'N'}'), '\\p{{Cc}}', ' ', 'g')"


def keyed(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({folded(x)}, '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sounded(x: str) -> str:
    out = keyed(x)
    for a, b in PHONETIC:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"
