"""Queries of the gazetteer's build chain and of file sources and sinks, with their oracles.

Sources are read from files that a query writes itself into the shared folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..data import lexicon
from ..functions import geo, text as T
from ..operators import build, desk, gazetteer as gaz, locate as loc, normalize as norm, resolve as res
from ..sources import files
from ..sources.shared import fresh_path
from . import fixtures as X
from .desk import segments
from .queries import ENTRIES, RING_SQL, SEGMENT, _rings, query


def points(*names: str):
    """A line's points from pairs of columns lng<i>, lat<i>."""
    return F.array(*[F.struct(F.col(f"lng{i}").alias("lng"), F.col(f"lat{i}").alias("lat")) for i in names])


def one_file(spark: SparkSession, text: DataFrame, label: str) -> str:
    """The rows of a one-column text table, written as a folder of one text file."""
    path = fresh_path(spark, label)
    text.coalesce(1).write.text(path)
    return path


# -- streets ---------------------------------------------------------------------
TAGS = """SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 8 WHEN 0 THEN 'admin_level=8;boundary=administrative;pe:ubigeo=150101' WHEN 1 THEN 'addr:street=Av. X;addr:housenumber=10' WHEN 2 THEN 'addr:housenumber=12'
WHEN 3 THEN 'place=suburb;name=El Sol' WHEN 4 THEN 'landuse=residential;name=El Mar' WHEN 5 THEN 'highway=residential;name=Calle 5' WHEN 6 THEN 'admin_level=8;name=Nada' ELSE 'place=city;name=Lima' END AS tags FROM part"""


@query(f"WITH t AS ({TAGS}) SELECT id, CASE id % 8 WHEN 0 THEN 'district' WHEN 1 THEN 'address' WHEN 2 THEN 'house_number' WHEN 3 THEN 'area' WHEN 4 THEN 'area' WHEN 5 THEN 'street' END AS kind FROM t")
def extract_kinds(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    tagged = spark.sql(TAGS).withColumn("tags", F.str_to_map("tags", F.lit(";"), F.lit("=")))
    elements = one_file(spark, tagged.select(F.to_json(F.struct(F.array(F.struct(F.lit("node").alias("type"), "id", "tags")).alias("elements"))).alias("value")), "extract")
    # One document a line here; a folder of them is read like one.
    read = spark.read.schema(files.OSM).json(elements).select(F.inline("elements"))
    return read.select("id", build.extract_kind(F.col("tags")).alias("kind"))


@query(X.sql("street") + "SELECT street_id AS way_id, CASE WHEN street_id % 5 = 2 THEN '' ELSE type END AS type, name AS display FROM street WHERE street_id % 5 NOT IN (0, 1)")
def way_names(spark, sf_dir):
    """Ways of streets: some are of a kind that is no street, some names hold a door's number, some have no type."""
    s = X.view(spark, sf_dir, "street")
    k = F.col("street_id") % 5
    name = F.when(k == 2, F.col("name")).when(k == 1, F.concat_ws(" ", F.nullif("type", F.lit("")), "name", F.lit("55"))).otherwise(F.concat_ws(" ", F.nullif("type", F.lit("")), F.lower("name")))
    tags = F.create_map(F.lit("name"), name, F.lit("highway"), F.when(k == 0, "footway").otherwise("residential"))
    ways = gaz.named_ways(s.select(F.col("street_id").alias("way_id"), tags.alias("tags"), points("0", "1").alias("points")))
    return build.read_names(ways, F.col("tags")["name"], ENTRIES).select("way_id", "type", "display")


MIDDLES = X.sql("street").rstrip() + ", anchor AS (SELECT street_id AS anchor_id, lng1 AS lng, lat1 AS lat FROM street)" + RING_SQL


@query(MIDDLES + "SELECT anchor_id AS way_id, min(ubigeo) AS ubigeo FROM inside GROUP BY anchor_id HAVING count(*) = 1")
def way_districts(spark, sf_dir):
    ways = X.view(spark, sf_dir, "street").select(F.col("street_id").alias("way_id"), points("0", "1").alias("points"))
    return build.way_districts(ways, geo.edges(_rings(spark, sf_dir)))


DRAWN = "SELECT street_id AS drawn_id, ubigeo, type, CASE WHEN street_id % 2 = 0 THEN name ELSE 'CALLE NUEVA' END AS name, lng0, lat0, lng1, lat1, street_id % 21 = 0 AS gone FROM street WHERE street_id % 7 = 0"


@query(X.sql("street") + f", d AS ({DRAWN}), w AS (SELECT 'w' || street_id AS ref, ubigeo, type, name FROM street UNION ALL SELECT 'm' || drawn_id, ubigeo, type, name FROM d WHERE NOT gone) SELECT ubigeo, type, name AS key, count(*) AS n_lines, string_agg(ref, ' ' ORDER BY ref) AS refs FROM w GROUP BY ubigeo, type, name")
def streets_with_drawn(spark, sf_dir):
    s = X.view(spark, sf_dir, "street")
    s.createOrReplaceTempView("street")
    drawn = spark.sql(DRAWN).select("drawn_id", "ubigeo", "type", "name", points("0", "1").alias("points"), F.when(F.col("gone"), F.current_timestamp()).alias("deleted_at"))
    ways = s.select(F.concat(F.lit("w"), F.col("street_id").cast("string")).alias("ref"), "ubigeo", "type", "name", F.array().cast("array<string>").alias("aliases"), points("0", "1").alias("points"))
    g = gaz.grouped_streets(build.with_drawn(ways, drawn))
    return g.select("ubigeo", "type", "key", F.size("lines").cast("long").alias("n_lines"), F.array_join("refs", " ").alias("refs"))


@query(X.sql("street") + """, s AS (SELECT street_id AS pos, ubigeo || '|' || type || '|' || key || '|' || CASE WHEN street_id % 3 = 0 THEN '90' ELSE '1' || street_id END AS t FROM street),
h AS (SELECT pos, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(t, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS v FROM s),
i AS (SELECT pos, greatest(1, v // 17179869184::HUGEINT)::BIGINT AS id FROM h)
SELECT pos, id + row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS street_id FROM i""")
def stable_street_ids(spark, sf_dir):
    """Streets without type share their hash where their oldest way does, so some take the next number."""
    s = X.view(spark, sf_dir, "street")
    own = F.concat(F.lit("1"), F.col("street_id").cast("string"))
    refs = F.when(F.col("street_id") % 3 == 0, F.array(F.lit("100"), F.lit("90"))).otherwise(F.array(F.concat(own, F.lit("0")), own))
    return build.stable_ids(s.select(F.col("street_id").alias("pos"), "ubigeo", "type", "key", refs.alias("refs"))).select("pos", "street_id")


@query("WITH g AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'OSM-n' || p_partkey WHEN 1 THEN 'SYN-n' || p_partkey || '-2' ELSE 'EMS-' || p_partkey END AS id, CASE WHEN p_partkey % 4 = 0 THEN 'test' ELSE 'dev' END AS split, p_partkey AS k FROM part) SELECT DISTINCT CASE k % 3 WHEN 2 THEN id ELSE 'n' || k END AS osm_id FROM g WHERE split = 'test'")
def golden_exclusion(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.col("p_partkey").cast("string"))
    i = F.col("p_partkey") % 3
    ident = F.when(i == 0, F.concat(F.lit("OSM-n"), "k")).when(i == 1, F.concat(F.lit("SYN-n"), "k", F.lit("-2"))).otherwise(F.concat(F.lit("EMS-"), "k"))
    return build.held_points(p.select(ident.alias("id"), F.when(F.col("p_partkey") % 4 == 0, "test").otherwise("dev").alias("split")))


NEAR = SEGMENT.format(cols="point_id, key", rows="(SELECT a.anchor_id AS point_id, s.key, a.lng, a.lat, s.lng0, s.lat0, s.lng1, s.lat1 FROM anchor a JOIN street s ON abs(s.lat0 - a.lat) < 5e-3)") + """,
kk AS (SELECT point_id, key, min(metres) AS metres FROM seg GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY metres, key) AS n, lead(metres) OVER (PARTITION BY point_id ORDER BY metres, key) AS second FROM kk),
near AS (SELECT point_id, key FROM o WHERE n = 1 AND metres <= 40 AND (second IS NULL OR second >= 2 * metres + 15))
"""


@query(X.sql("anchor") + NEAR + """SELECT anchor_id AS point_id, CASE WHEN r = 'ok' THEN number END AS number, CASE WHEN r = 'ok' THEN key END AS key, r AS reason FROM (
SELECT a.anchor_id, a.number, near.key, CASE WHEN anchor_id % 9 = 0 THEN 'es_lote' WHEN anchor_id % 7 = 0 THEN 'numero_no_simple' WHEN near.key IS NULL THEN 'sin_calle_clara' ELSE 'ok' END AS r FROM anchor a LEFT JOIN near ON near.point_id = a.anchor_id)""")
def unlabelled_numbers(spark, sf_dir):
    a = X.view(spark, sf_dir, "anchor")
    no = F.when(F.col("anchor_id") % 7 == 0, F.concat(F.col("number").cast("string"), F.lit("-12"))).when(F.col("anchor_id") % 5 == 0, F.concat(F.col("number").cast("string"), F.lit(" b"))).otherwise(F.col("number").cast("string"))
    p = a.select(F.col("anchor_id").alias("point_id"), no.alias("house_number"), F.when(F.col("anchor_id") % 9 == 0, "A").alias("plot"), "lng", "lat")
    return build.house_numbers(p, X.view(spark, sf_dir, "street"))


@query(X.sql("anchor") + NEAR + """SELECT count(*) AS tried, count(*) FILTER (WHERE near.key = s.key OR (near.key = 'LOS SAUCES' AND s.key = 'SAN MARTIN')) AS "right" FROM near JOIN anchor a ON near.point_id = a.anchor_id JOIN street s USING (street_id)""")
def nearest_precision(spark, sf_dir):
    s = X.view(spark, sf_dir, "street")
    p = X.view(spark, sf_dir, "anchor").join(s.select("street_id", F.col("key").alias("own_key")), "street_id").select(F.col("anchor_id").alias("point_id"), "own_key", "lng", "lat")
    return build.nearest_precision(p, s, spark.createDataFrame([("LOS SAUCES", "SAN MARTIN")], "key string, alias string"))


@query(X.sql("anchor") + SEGMENT.format(cols="point_id, sid, same", rows="(SELECT a.anchor_id AS point_id, s.street_id AS sid, s.type = p.type AS same, a.lng, a.lat, s.lng0, s.lat0, s.lng1, s.lat1 FROM anchor a JOIN street p ON a.street_id = p.street_id JOIN street s ON s.ubigeo = p.ubigeo AND s.key = p.key)") + """,
b AS (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY same DESC, round(metres, 6), sid) = 1),
r AS (SELECT a.*, b.sid, CASE WHEN anchor_id % 10 = 0 THEN 'excluido_test' WHEN anchor_id % 7 = 0 THEN 'numero_no_simple' WHEN anchor_id % 11 = 0 THEN 'sin_distrito' WHEN anchor_id % 13 = 0 THEN 'calle_no_parseable' WHEN anchor_id % 17 = 0 THEN 'sin_calle' WHEN metres > 120 THEN 'lejos_de_su_calle' ELSE 'ok' END AS reason FROM anchor a JOIN b ON b.point_id = a.anchor_id)
SELECT anchor_id AS point_id, CASE WHEN reason = 'ok' THEN sid END AS street_id, CASE WHEN reason = 'ok' THEN number END AS number, reason FROM r""")
def labelled_anchors(spark, sf_dir):
    s = X.view(spark, sf_dir, "street")
    i = F.col("anchor_id")
    p = X.view(spark, sf_dir, "anchor").drop("ubigeo").join(s.select("street_id", "ubigeo", "key", "type"), "street_id")
    p = p.select(
        i.alias("point_id"), F.concat(F.lit("n"), i.cast("string")).alias("osm_id"), F.when(i % 7 == 0, "S/N").otherwise(F.col("number").cast("string")).alias("house_number"),
        F.when(i % 11 != 0, F.col("ubigeo")).alias("ubigeo"), F.when(i % 13 == 0, "").when(i % 17 == 0, "OTRA CALLE").otherwise(F.col("key")).alias("key"), "type", "lng", "lat",
    )
    held = build.held_points(p.where(F.col("point_id") % 10 == 0).select(F.concat(F.lit("OSM-"), "osm_id").alias("id"), F.lit("test").alias("split")))
    return build.labelled_anchors(p, s, held)


@query(X.sql("anchor") + "SELECT street_id, string_agg(number || ':' || anchor_id, ' ' ORDER BY number, lng, lat, anchor_id) AS anchors FROM anchor GROUP BY street_id")
def sorted_anchors(spark, sf_dir):
    a = build.sorted_anchors(X.view(spark, sf_dir, "anchor"))
    return a.select("street_id", F.array_join(F.transform("anchors", lambda x: F.concat_ws(":", x["number"].cast("string"), x["anchor_id"].cast("string"))), " ").alias("anchors"))


@query(X.sql("street") + """, b AS (SELECT street_id, unnest(CASE WHEN street_id % 3 = 0 THEN [0, 30, 80, 200] WHEN street_id % 3 = 1 THEN [0, 100, 200] ELSE [0, 200] END) AS lo FROM street)
SELECT street_id, (row_number() OVER w - 1)::INT AS block, lo::DOUBLE AS lo, (lead(lo) OVER w)::DOUBLE AS hi FROM b WINDOW w AS (PARTITION BY street_id ORDER BY lo) QUALIFY hi IS NOT NULL""")
def bare_blocks(spark, sf_dir):
    """Streets of 200 m: cuts too close to the one before, or to the end, count for nothing."""
    s = X.view(spark, sf_dir, "street").select("street_id")
    k = F.col("street_id") % 3
    cuts = s.select("street_id", F.explode(F.when(k == 0, F.array(F.lit(30.0), F.lit(54.0), F.lit(80.0), F.lit(180.0))).when(k == 1, F.array(F.lit(10.0), F.lit(100.0))).otherwise(F.array(F.lit(190.0)))).alias("cut"))
    return build.bare_blocks(s.select("street_id", F.lit(0.0).alias("lo"), F.lit(200.0).alias("hi")), cuts)


# -- polygons --------------------------------------------------------------------
def _relations(spark, sf_dir) -> DataFrame:
    """A square a nation, in four ways that are shuffled, some of them turned, with a needless point on one side; some lack one way's role."""
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation")
    n = spark.sql("SELECT '15' || lpad(CAST(n_nationkey AS VARCHAR(10)), 4, '0') AS ubigeo, n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN 'Otro' ELSE n_name END AS name FROM nation")
    p = lambda x, y: F.struct((F.lit(-12.0) + F.col("k") * 0.1 + y).alias("lat"), (F.lit(-77.0) + F.col("k") * 0.1 + x).alias("lon"))
    way = lambda role, *xy: F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), F.array(*[p(*q) for q in xy]).alias("geometry"))
    a, b, c, d = (0, 0), (0.05, 0), (0.05, 0.05), (0, 0.05)
    other = F.struct(F.lit("node").alias("type"), F.lit("label").alias("role"), F.array(p(0.02, 0.02)).alias("geometry"))
    members = F.array(way("outer", a, (0.02, 0.00001), b), way("", d, c), other, way("outer", b, c), way("outer", d, a), way("inner", (0.01, 0.01), (0.02, 0.01), (0.02, 0.02), (0.01, 0.01)))
    return n.select("ubigeo", "k", "name", members.alias("members"))


def _outlines(spark, sf_dir) -> DataFrame:
    catalog = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("15"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("code"), F.col("n_name").alias("district"))
    return build.district_polygons(_relations(spark, sf_dir), catalog, 0.0001)


OUTLINES = """WITH n AS (SELECT '15' || lpad(n_nationkey::VARCHAR, 4, '0') AS ubigeo, n_nationkey % 4 = 0 AS renamed FROM nation)
SELECT ubigeo, renamed, unnest([0, 1])::INT AS ring, unnest([5, 4])::INT AS n_points, unnest([2.5e-3, 5e-5]) AS area FROM n"""


def _areas(polygons: DataFrame, *more: str) -> DataFrame:
    part = F.expr("transform(sequence(0, size(points) - 2), i -> points[i].lng * points[i + 1].lat - points[i + 1].lng * points[i].lat)")
    return polygons.select("ubigeo", *more, "ring", F.size("points").alias("n_points"), F.round(F.abs(F.aggregate(part, F.lit(0.0), lambda s, x: s + x)) / 2, 7).alias("area"))


@query(OUTLINES)
def district_outlines(spark, sf_dir):
    return _areas(_outlines(spark, sf_dir), "renamed")


@query(OUTLINES.replace("ubigeo, renamed, ", "ubigeo, "))
def polygon_files(spark, sf_dir):
    """Outlines written as one document and read again."""
    path = fresh_path(spark, "polygons")
    files.write_polygons(_outlines(spark, sf_dir).withColumn("osm_relation", F.lit(7).cast("long")), path, "2024-01-01T00:00:00Z", 0.0001)
    return _areas(files.district_polygons(spark, path))


@query(X.sql("street") + "SELECT street_id, 2 AS n, round(lng0, 5) AS lng, round(lat1, 5) AS lat FROM street UNION ALL SELECT -street_id, 1, round(lng0, 5), round(lat0, 5) FROM street")
def wkt_parse(spark, sf_dir):
    """Lines and points written as text and read again; other text has no lines."""
    s = X.view(spark, sf_dir, "street")
    text = s.select("street_id", files.wkt_lines(F.array(points("0", "1"))).alias("t")).unionByName(s.select((-F.col("street_id")).alias("street_id"), F.format_string("POINT (%.6f %.6f)", "lng0", "lat0").alias("t")))
    text = text.unionByName(s.select("street_id", F.lit("POLYGON((0 0))").alias("t")))
    line = F.get(F.col("lines"), F.lit(0))
    d = text.select("street_id", files.parse_wkt(F.col("t")).alias("lines")).where("lines IS NOT NULL")
    return d.select("street_id", F.size(line).alias("n"), F.round(F.element_at(line, 1)["lng"], 5).alias("lng"), F.round(F.element_at(line, -1)["lat"], 5).alias("lat"))


# -- files -----------------------------------------------------------------------
@query(X.sql("street") + "SELECT 'part-' || k AS file_kind, street_id AS id, name, round(lng1, 6) AS lng, '2024-05-0' || (k + 1) AS stamp FROM (SELECT *, street_id % 2 AS k FROM street)")
def extract_folder(spark, sf_dir):
    """Map extracts of two files, read as a folder, with the time that each states."""
    s = X.view(spark, sf_dir, "street")
    root, stamps = fresh_path(spark, "osm"), []
    for k in (0, 1):
        part = s.where(F.col("street_id") % 2 == k)
        geometry = F.array(*[F.struct(F.col(f"lat{i}").alias("lat"), F.col(f"lng{i}").alias("lon")) for i in (0, 1)])
        element = F.struct(F.lit("way").alias("type"), F.col("street_id").alias("id"), F.create_map(F.lit("name"), F.col("name")).alias("tags"), geometry.alias("geometry"))
        whole = part.agg(F.collect_list(element).alias("elements")).select(F.to_json(F.struct(F.struct(F.lit(f"2024-05-0{k + 1}").alias("timestamp_osm_base")).alias("osm3s"), "elements")).alias("value"))
        whole.coalesce(1).write.text(f"{root}/district={k}")
        stamps.append(files.osm_stamp(spark, f"{root}/district={k}"))
    read = [files.osm_elements(spark, f"{root}/district={k}/*").select(F.lit(f"part-{k}").alias("file_kind"), "id", F.col("tags")["name"].alias("name"), F.round(F.get("geometry", F.lit(1))["lon"], 6).alias("lng"), F.lit(stamps[k]).alias("stamp")) for k in (0, 1)]
    return read[0].unionByName(read[1])


GOLDEN_ROWS = """SELECT 'OSM-n' || CAST(c_custkey AS VARCHAR(20)) AS id, 'osm' AS source, 'Av. "Los" Pinos, ' || CAST(c_custkey AS VARCHAR(20)) AS raw_address, CASE WHEN c_custkey % 2 = 0 THEN 'Ate' ELSE '' END AS district_field, CAST(c_custkey % 900 AS VARCHAR(10)) AS expected_number,
CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'dev' END AS split, CASE WHEN c_custkey % 5 = 0 THEN 'DPTO 3' ELSE '' END AS expected_interior FROM customer"""


@query(GOLDEN_ROWS)
def golden_files(spark, sf_dir):
    """An evaluation set written and read again; quotes and commas stay."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    rows = spark.sql(GOLDEN_ROWS)
    full = rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in (*files.GOLDEN, files.INTERIOR)])
    path = fresh_path(spark, "golden")
    files.write_golden(full, path)
    return files.golden_csv(spark, path).select(*rows.columns)


SAMPLES = """SELECT CAST(c_custkey AS VARCHAR(20)) AS id_muestra, 'c' || CAST(c_custkey % 7 AS VARCHAR(10)) AS cuenta, 'Av. Los Pinos ' || CAST(c_custkey % 900 + 1 AS VARCHAR(10)) AS direccion, '' AS numero, '' AS referencia, 'Lince' AS distrito, 'Lima' AS provincia, 'Lima' AS departamento, '' AS ubigeo FROM customer"""


@query(f"WITH s AS ({SAMPLES}) SELECT *, 'AVENIDA' AS p_tipo_via, 'LOS PINOS' AS p_nombre_via, split_part(direccion, ' ', 4) AS p_numero, '' AS p_interior, '' AS p_mz, '' AS p_lt, '' AS p_urbanizacion, '' AS p_referencia, '150116' AS p_ubigeo, 'AVENIDA LOS PINOS ' || split_part(direccion, ' ', 4) AS p_normalizada, 'ABBREVIATION_EXPANDED' AS p_flags FROM s")
def sample_proposals(spark, sf_dir):
    """A sample read from a file, what the normalizer proposes, and the sheet written and read again."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    path, sheet = fresh_path(spark, "sample"), fresh_path(spark, "sheet")
    files.write_csv(spark.sql(SAMPLES).select(*reversed(files.SAMPLE)), path)
    sample = files.sample_csv(spark, path)
    asked = sample.select("*", F.col("direccion").alias("address"), F.col("distrito").alias("district"), F.col("provincia").alias("province"), F.col("departamento").alias("department"))
    files.write_csv(files.proposals(norm.normalize(asked, ENTRIES, frozenset({"LIMA_METRO"}))), sheet)
    return files.csv_rows(spark, sheet)


@query("SELECT c_custkey AS external_id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Jr. X ' || c_custkey END AS address, 'Ate' AS district, '' AS number FROM customer")
def csv_import(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    path = fresh_path(spark, "import")
    k = F.col("c_custkey").cast("string")
    files.write_csv(c.select(k.alias("ID"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("Jr. X "), k)).alias("Direccion"), F.lit("Ate").alias("DISTRITO")), path)
    return files.import_csv(spark, path).select(F.col("external_id").cast("long").alias("external_id"), "address", "district", "number")


@query("SELECT c_custkey::VARCHAR AS id_muestra, DATE '2024-01-02' AS day, -12.0 AS lat, -77.0 - (c_custkey % 10) / 1e1 AS lng, CASE WHEN c_custkey % 2 = 0 THEN -12.5 END AS arr_lat FROM customer WHERE c_custkey % 5 <> 0")
def gps_import(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    path = fresh_path(spark, "gps")
    k = F.col("c_custkey")
    cells = {"id_muestra": k.cast("string"), "fecha_entrega": F.lit("2024-01-02"), "lat_entrega": F.when(k % 5 == 0, "x").otherwise("-12.0"), "lng_entrega": (-77.0 - (k % 10) / 10.0).cast("string"), "lat_llegada": F.when(k % 2 == 0, "-12.5").otherwise("")}
    files.write_csv(c.select(*[cells.get(name, F.lit("")).alias(name) for name in (*files.GPS, "lat_llegada", "lng_llegada")]), path)
    return files.gps_csv(spark, path).select("id_muestra", "day", "lat", "lng", "arr_lat")


@query(X.sql("request") + "SELECT req_id::VARCHAR AS external_id, CASE WHEN req_id % 2 = 0 THEN 'RESOLVED' ELSE 'REVIEW_REQUIRED' END AS status, CASE WHEN req_id % 2 = 0 THEN '-12.5' ELSE '' END AS lat, 'A;B' AS flags FROM request")
def result_files(spark, sf_dir):
    r = X.view(spark, sf_dir, "request")
    status = F.when(F.col("req_id") % 2 == 0, "RESOLVED").otherwise("REVIEW_REQUIRED")
    rows = r.select(F.col("req_id").alias("external_id"), F.col("req_key").alias("address"), F.lit("Ate").alias("district"), status.alias("status"), F.lit("REVIEW").alias("decision"), F.lit("STREET").alias("precision_level"), F.lit(-12.5).alias("lat"), F.lit(-77.5).alias("lng"), "ubigeo", F.lit("").alias("canonical_address"), F.lit(1).alias("ticket_id"), F.array(F.lit("A"), F.lit("B")).alias("flags"))
    path = fresh_path(spark, "results")
    files.write_csv(files.results(rows), path)
    return files.csv_rows(spark, path).select("external_id", "status", "lat", "flags")


@query(X.sql("request") + "SELECT req_id AS pos, '{\"external_id\":\"' || req_id || '\",\"decision\":\"REVIEW\"}' AS value FROM request")
def batch_ndjson(spark, sf_dir):
    r = X.view(spark, sf_dir, "request").select(F.col("req_id").alias("pos"), F.col("req_id").cast("string").alias("external_id"), F.lit("REVIEW").alias("decision"))
    path = fresh_path(spark, "batch")
    files.write_batch(r, path)
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.external_id").cast("long").alias("pos"), "value")


@query(X.sql("street") + "SELECT street_id, name, 2 AS version FROM street WHERE street_id % 2 = 0")
def snapshot_versions(spark, sf_dir):
    """The newest published version holds; one without its mark does not count."""
    s, root = X.view(spark, sf_dir, "street").select("street_id", "name"), fresh_path(spark, "snapshot")
    files.publish({"street": s.withColumn("version", F.lit(1))}, root, "1")
    files.publish({"street": s.where("street_id % 2 = 0").withColumn("version", F.lit(2))}, root, "2")
    s.withColumn("version", F.lit(3)).write.parquet(f"{root}/version=3/street")
    return files.latest(spark, root)["street"]


@query(X.sql("request") + "SELECT req_id, 'AVENIDA' AS street_type, 'LOS PINOS' AS street_name, req_id % 900 || '' AS number, true AS in_scope, 'callejero/1 lexicon/propio' AS version FROM request")
def lexicon_files(spark, sf_dir):
    """A lexicon with a variant of its own, and zones, read from files when the query runs."""
    own = {"version": "propio", "street_types": {"AVENIDA": ["AVX"]}, "noise_prefixes": ["HOLA"]}
    words = one_file(spark, spark.createDataFrame([(json.dumps(own),)], "value string"), "lexicon")
    zones = one_file(spark, spark.createDataFrame([(json.dumps({"zones": {"LIMA_METRO": "active", "AREQUIPA": "planned"}}),)], "value string"), "zones")
    text = lambda path: "\n".join(r.value for r in spark.read.text(path).collect())
    asked = X.view(spark, sf_dir, "request").select("req_id", F.concat(F.lit("Hola: avx los pinos "), (F.col("req_id") % 900).cast("string"), F.lit(", Lince")).alias("address"))
    read = norm.normalize(asked, ENTRIES, lexicon.zones(text(zones)), lexicon=lexicon.parse(text(words)))
    return read.select("req_id", "street_type", "street_name", "number", "in_scope", "version")


# -- the desk, and what the resolver tells about streets --------------------------
SUGGESTED = X.sql("anchor", "request") + """, e AS (SELECT street_id, number, min(lng) AS lng, min(lat) AS lat FROM (SELECT street_id, number, round(lng + 1e-3, 6) AS lng, round(lat, 6) AS lat FROM anchor WHERE anchor_id % 10 = 0) GROUP BY ALL)
SELECT r.req_id, e.lng, e.lat, 'ADDRESS_POINT' AS precision FROM request r JOIN e ON e.street_id = r.street_id AND e.number = r.num"""


@query(SUGGESTED)
def suggest_with_edits(spark, sf_dir):
    """Where a number stands once live edits replace the snapshot's anchors: shown for the numbers that were edited."""
    a = X.view(spark, sf_dir, "anchor").withColumn("ref", F.concat(F.lit("osm:n"), F.col("anchor_id").cast("string")))
    edits = a.where("anchor_id % 10 = 0").groupBy("street_id", "number").agg(F.min(F.round(F.col("lng") + 1e-3, 6)).alias("lng"), F.min(F.round("lat", 6)).alias("lat")).withColumn("ref", F.lit("manual:1"))
    r = X.view(spark, sf_dir, "request")
    edited = r.join(edits.select("street_id", F.col("number").alias("num")), ["street_id", "num"], "left_semi")
    asked = edited.select("req_id", "street_id", "num", F.lit(None).cast("double").alias("near_lng"), F.lit(None).cast("double").alias("near_lat"))
    none = a.limit(0).select("street_id", "lng", "lat", F.lit(0).alias("hundred"))
    g = loc.prepared(segments(spark, sf_dir), res.with_edits(a, edits), none, none, a.limit(0).select("street_id", "number", "lng", "lat"))
    at = loc.on_street(asked, g)
    return at.select("req_id", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "precision")


@query(X.sql("anchor") + """, h AS (SELECT street_id, floor(number / 100)::INT AS hundred, count(*) AS n_numbers, min(number) AS first, max(number) AS last FROM anchor GROUP BY ALL) SELECT street_id, hundred, n_numbers, first, last FROM h""")
def street_detail(spark, sf_dir):
    return res.street_hundreds(X.view(spark, sf_dir, "anchor"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'OUT_OF_SCOPE' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'RESOLVED' END AS status, CASE o_orderkey % 3 WHEN 1 THEN 'AMBIGUOUS_STREET' ELSE 'REVIEW' END AS reason FROM orders")
def decision_reasons(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 3
    decision = F.when(k == 0, "REJECT").when(k == 1, "REVIEW").otherwise("AUTO_ACCEPT")
    flags = F.when(k == 1, F.array(F.lit("ABBREVIATION_EXPANDED"), F.lit("AMBIGUOUS_STREET"))).otherwise(F.array(F.lit("NO_NUMBER")))
    return o.select(F.col("o_orderkey").alias("id"), res.status_of(decision).alias("status"), res.reason_of(flags).alias("reason"))


@query(X.sql("street") + f", d AS ({DRAWN}) SELECT drawn_id, CASE WHEN drawn_id % 35 = 0 THEN 'TOO_FEW_POINTS' WHEN drawn_id % 14 = 0 THEN 'NO_NAME' WHEN drawn_id % 49 = 0 THEN 'OUTSIDE_DISTRICT' ELSE '' END AS error FROM d")
def drawn_street_checks(spark, sf_dir):
    X.view(spark, sf_dir, "street").createOrReplaceTempView("street")
    i = F.col("drawn_id")
    return spark.sql(DRAWN).select("drawn_id", desk.drawn_street_error(i % 49 != 0, F.when(i % 14 == 0, " ").otherwise(F.col("name")), F.when(i % 35 == 0, 1).otherwise(2)).alias("error"))


@query(X.sql("street") + f", d AS ({DRAWN}) SELECT drawn_id, name FROM d WHERE ubigeo = '150116' AND NOT gone")
def drawn_street_list(spark, sf_dir):
    X.view(spark, sf_dir, "street").createOrReplaceTempView("street")
    drawn = spark.sql(DRAWN).withColumn("deleted_at", F.when(F.col("gone"), F.current_timestamp()))
    return desk.drawn_streets(drawn, "150116").select("drawn_id", "name")


@query("SELECT 'v' || max(s_suppkey % 4) AS version, true AS same FROM supplier")
def version_check(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("v"), (F.col("s_suppkey") % 4).cast("string")).alias("snapshot_version"))
    return desk.same_version(s, "v3")


@query(X.sql("street", "anchor") + SEGMENT.format(cols="anchor_id", rows="(SELECT a.anchor_id, a.lng, a.lat, s.lng0, s.lat0, s.lng1, s.lat1 FROM anchor a JOIN street s USING (street_id))") + "SELECT anchor_id AS req_id, round(metres, 3) AS metres FROM seg")
def nearest_on_street(spark, sf_dir):
    p = X.view(spark, sf_dir, "anchor").select(F.col("anchor_id").alias("req_id"), "street_id", F.col("lng").alias("near_lng"), F.col("lat").alias("near_lat"))
    return loc.nearest_of_street(p, segments(spark, sf_dir)).select("req_id", F.round("metres", 3).alias("metres"))


@query(X.sql("street") + """, x AS (SELECT street_id, lng0, lat0, lng1, lat1, unnest([-50.0, 0.0, 40.0, 1e6]) AS asked, sqrt(pow((lng1 - lng0) * cos(radians((lat0 + lat1) / 2)) * 111194.92664455873, 2) + pow((lat1 - lat0) * 111194.92664455873, 2)) AS m FROM street),
c AS (SELECT *, greatest(0, least(1, (asked + m / 2) / m)) AS t FROM x)
SELECT street_id, asked, round(lng0 + t * (lng1 - lng0), 6) AS lng, round(lat0 + t * (lat1 - lat0), 6) AS lat FROM c""")
def points_along(spark, sf_dir):
    """The street's point at a chainage from its centre; beyond its ends, the end."""
    s = segments(spark, sf_dir)
    asked = s.select("street_id", F.explode(F.array(*map(F.lit, (-50.0, 0.0, 40.0, 1e6)))).alias("chainage"))
    asked = asked.withColumn("asked", F.col("chainage")).withColumn("req_id", F.concat_ws("|", F.col("street_id").cast("string"), F.col("asked").cast("string")))
    # The fixture's streets run eastwards, as the axis does.
    at = loc.points_at(asked.select("req_id", "street_id", "chainage", "asked"), s, loc.frames(s), ("street_id", "asked"))
    return at.select("street_id", "asked", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


@query(X.sql("street") + f""", d AS (SELECT drawn_id, 'drawn' AS kind, gone FROM ({DRAWN})), e AS (SELECT street_id, CASE WHEN street_id % 2 = 0 THEN 'mark' ELSE 'number' END AS kind FROM street WHERE street_id % 4 <> 0)
SELECT kind, count(*) FILTER (WHERE street_id % 3 <> 0) AS applied, count(*) FILTER (WHERE street_id % 3 = 0) AS orphans FROM e GROUP BY kind""")
def edit_orphans(spark, sf_dir):
    """Edits of a build's streets under the next build, which lost every third street."""
    s = X.view(spark, sf_dir, "street")
    i = F.col("street_id")
    edits = s.select("street_id", F.when(i % 2 == 0, "mark").otherwise("number").alias("kind"), F.when(i % 4 == 0, F.current_timestamp()).alias("deleted_at"))
    return gaz.edit_counts(s.where(i % 3 != 0), edits)


LINES = "SELECT street_id AS line_id, -77.07e0 + (street_id % 13) * 5e-3 AS lng0, -12.04e0 + (street_id % 7) * 7e-3 AS lat0, -77.07e0 + (street_id % 13) * 5e-3 + (street_id % 4) * 4e-3 AS lng1, -12.04e0 + (street_id % 7) * 7e-3 + (street_id % 3) * 6e-3 + 1e-4 AS lat1 FROM street"


@query(X.sql("street").rstrip() + f", lines AS ({LINES}), anchor AS (SELECT line_id * 2 AS anchor_id, lng0 AS lng, lat0 AS lat FROM lines UNION ALL SELECT line_id * 2 + 1, lng1, lat1 FROM lines)" + RING_SQL + """, t AS (SELECT line_id, ubigeo, (lng1 - lng0) * (y0 - lat0) - (lat1 - lat0) * (x0 - lng0) AS a, (lng1 - lng0) * (y1 - lat0) - (lat1 - lat0) * (x1 - lng0) AS b, (x1 - x0) * (lat0 - y0) - (y1 - y0) * (lng0 - x0) AS c, (x1 - x0) * (lat1 - y0) - (y1 - y0) * (lng1 - x0) AS d FROM lines, edge)
SELECT anchor_id // 2 AS line_id, ubigeo FROM inside UNION SELECT line_id, ubigeo FROM t WHERE a * b <= 0 AND c * d <= 0""")
def lines_touching(spark, sf_dir):
    X.view(spark, sf_dir, "street").createOrReplaceTempView("street")
    lines = spark.sql(LINES).select("line_id", points("0", "1").alias("points"))
    return geo.touching(lines, geo.edges(_rings(spark, sf_dir)))


@query("SELECT CAST(s_suppkey % 3 AS VARCHAR) AS ubigeo, 'NOMBRE ' || (s_suppkey % 5) AS alias, s_suppkey AS street_id, 'op1' AS operator FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 5 <> 0")
def alias_votes(spark, sf_dir):
    """Names that operators found in place of a street's own, from accepted pins."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("street_id"))
    i = F.col("street_id")
    streets = s.select("street_id", (i % 3).cast("string").alias("ubigeo"), F.lit("NOMBRE 0").alias("key"))
    tickets = s.select(i.alias("ticket_id"), F.concat(F.lit("Nombré "), (i % 5).cast("string")).alias("street_name"))
    judged = s.select(i.alias("ticket_id"), "street_id", F.lit("op1").alias("actor"), F.when(i % 4 == 0, "").otherwise("CLOSED").alias("error"), F.lit("pin").alias("action"))
    return desk.alias_candidates(judged, tickets, streets)


@query("SELECT n_nationkey AS id, 'ñandú áéíóú Ñ' || n_nationkey AS text FROM nation")
def mojibake_repair(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    wrong = F.concat(F.lit("ñandú áéíóú Ñ".encode().decode("cp1252")), F.col("n_nationkey").cast("string"))
    return n.select(F.col("n_nationkey").alias("id"), T.fix_mojibake(wrong).alias("text"))
