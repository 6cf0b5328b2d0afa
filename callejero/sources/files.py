"""File sources and sinks of the engine: map extracts, polygons, CSV imports, workbooks, snapshots."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OSM = "elements array<struct<type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>, members: array<struct<type: string, role: string, geometry: array<struct<lat: double, lon: double>>>>>>"
#: The columns that an import may call a field by.
SYNONYMS = {
    "external_id": ("external_id", "id"), "address": ("address", "direccion", "raw_address"), "number": ("number", "numero"), "reference": ("reference", "referencia"),
    "district": ("district", "distrito", "district_field"), "province": ("province", "provincia", "province_field"), "department": ("department", "departamento", "department_field"), "ubigeo": ("ubigeo",),
}
#: The columns of an evaluation set, of a sample, and what a proposal adds to a sample.
GOLDEN = (
    "id", "source", "raw_address", "district_field", "province_field", "department_field", "expected_street_type", "expected_street_name", "expected_number", "expected_block",
    "expected_lot", "expected_urbanization", "expected_ubigeo", "lat_verified", "lng_verified", "verification_method", "verified_by", "split", "notes",
)
INTERIOR = "expected_interior"
SAMPLE = ("id_muestra", "cuenta", "direccion", "numero", "referencia", "distrito", "provincia", "departamento", "ubigeo")
PROPOSED = {
    "p_tipo_via": "street_type", "p_nombre_via": "street_name", "p_numero": "number", "p_interior": "interior", "p_mz": "block", "p_lt": "lot", "p_urbanizacion": "urbanization",
    "p_referencia": "reference", "p_ubigeo": "loc_ubigeo", "p_normalizada": "normalized", "p_flags": "flags",
}
GPS = ("id_muestra", "direccion", "numero", "referencia", "distrito", "provincia", "departamento", "ubigeo", "fecha_entrega", "lat_entrega", "lng_entrega")


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row per element of map extracts (a file, folder or pattern), with the file it came from."""
    return spark.read.schema(OSM).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), F.inline("elements"))


def district_polygons(spark: SparkSession, path: str) -> DataFrame:
    """ubigeo, name, ring, points: one row per ring; raises on codes that are malformed or repeat."""
    d = spark.read.schema("districts array<struct<ubigeo: string, name: string, osm_relation: long, rings: array<array<array<double>>>>>").option("multiLine", True).json(path).select(F.inline("districts"))
    n, distinct, sound = d.agg(F.count("*"), F.count_distinct("ubigeo"), F.count_if(F.col("ubigeo").rlike("^[0-9]{6}$") & (F.size("rings") > 0))).first()
    if not n == distinct == sound:
        raise ValueError(f"{path}: codes must be six digits, unique, and have a ring")
    return d.select("ubigeo", "name", F.posexplode("rings").alias("ring", "p")).select("ubigeo", "name", "ring", F.transform("p", lambda x: F.struct(x[0].alias("lng"), x[1].alias("lat"))).alias("points"))


def import_csv(spark: SparkSession, path: str) -> DataFrame:
    """The request fields of a CSV under any of their names, in any case; missing ones are empty."""
    raw = spark.read.option("header", True).csv(path)
    by_name = {c.strip().lower(): c for c in raw.columns}
    pick = lambda names: F.coalesce(*[F.col(f"`{by_name[n]}`") for n in names if n in by_name], F.lit(""))
    return raw.select(*[pick(names).alias(field) for field, names in SYNONYMS.items()])


def gps_csv(spark: SparkSession, path: str) -> DataFrame:
    """Deliveries of an export; rows whose delivery point is no number are left out."""
    raw = spark.read.option("header", True).csv(path)
    if missing := [c for c in GPS if c not in raw.columns]:
        raise ValueError(f"{path}: columns missing: {', '.join(missing)}")
    number = lambda c: F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    d = raw.select(*GPS[:8], F.to_date("fecha_entrega").alias("day"), number("lat_entrega").alias("lat"), number("lng_entrega").alias("lng"), number("lat_llegada").alias("arr_lat"), number("lng_llegada").alias("arr_lng"))
    return d.where("lat IS NOT NULL AND lng IS NOT NULL")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files as text, empty ones as empty text; a row with another number of fields is an error. Fields may hold line breaks."""
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in head)
    d = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)
    return d.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) for c in head])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def golden_csv(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set: its columns in their order, and perhaps the interior's at the end (null where the file has none)."""
    d = csv_rows(spark, path)
    if tuple(d.columns) not in (GOLDEN, (*GOLDEN, INTERIOR)):
        raise ValueError(f"{path}: the columns must be {', '.join(GOLDEN)} and perhaps {INTERIOR}")
    return d if INTERIOR in d.columns else d.withColumn(INTERIOR, F.lit(None).cast("string"))


def write_golden(rows: DataFrame, path: str) -> None:
    """The interior's column is written if any row has one that is not null."""
    with_interior = not rows.where(F.col(INTERIOR).isNotNull()).isEmpty()
    write_csv(rows.select(*GOLDEN, *([INTERIOR] if with_interior else [])), path)


def sample_csv(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a sample, trimmed, wherever they stand in the file."""
    d = csv_rows(spark, path)
    if missing := [c for c in SAMPLE if c not in d.columns]:
        raise ValueError(f"{path}: columns missing: {', '.join(missing)}")
    return d.select(*[F.trim(c).alias(c) for c in SAMPLE])


def proposals(read: DataFrame) -> DataFrame:
    """A sample (columns of SAMPLE) with what the normalizer made of each row, as the columns of a labelling sheet; from a row with both."""
    made = [(F.array_join("flags", " ") if c == "flags" else F.col(c)).alias(name) for name, c in PROPOSED.items()]
    return read.select(*SAMPLE, *made)


def write_polygons(polygons: DataFrame, path: str, stamp: str, tolerance: float) -> None:
    """District outlines (ubigeo, name, osm_relation, ring, points) as one JSON document that ``district_polygons`` reads, with a ``_meta`` part; districts are few."""
    rings = F.transform("r", lambda x: F.transform(x["points"], lambda p: F.array(p["lng"], p["lat"])))
    d = polygons.groupBy("ubigeo", "name", "osm_relation").agg(F.sort_array(F.collect_list(F.struct("ring", "points"))).alias("r"))
    d = d.select("ubigeo", "name", "osm_relation", rings.alias("rings"))
    whole = d.agg(F.sort_array(F.collect_list(F.struct("ubigeo", "name", "osm_relation", "rings"))).alias("districts"))
    meta = F.struct(F.lit(stamp).alias("osm_timestamp"), F.lit(tolerance).alias("simplify_deg"), F.size("districts").alias("district_count"))
    whole.select(F.to_json(F.struct(meta.alias("_meta"), "districts")).alias("value")).coalesce(1).write.text(path)


def batch_lines(resolved: DataFrame, pos: str = "pos") -> DataFrame:
    """pos, value: one JSON object a row of a resolved batch."""
    return resolved.select(pos, F.to_json(F.struct(*[c for c in resolved.columns if c != pos])).alias("value"))


def write_batch(resolved: DataFrame, path: str, pos: str = "pos") -> None:
    """NDJSON in the order of ``pos``: its ranges become files whose names, and lines, rise with it."""
    lines = batch_lines(resolved, pos)
    lines.repartitionByRange(pos).sortWithinPartitions(pos).select("value").write.text(path)


def osm_stamp(spark: SparkSession, path: str) -> str | None:
    """The newest time that the map extracts of a path state as their base."""
    return spark.read.schema("osm3s struct<timestamp_osm_base: string>").option("multiLine", True).json(path).agg(F.max("osm3s.timestamp_osm_base")).first()[0]


def parse_wkt(text: Column) -> Column:
    """The lines, arrays of (lng, lat), of POINT, LINESTRING or MULTILINESTRING text; null of any other."""
    body = F.regexp_replace(F.upper(F.trim(text)), r"^(POINT|LINESTRING|MULTILINESTRING)\s*", "")
    sound = text.rlike(r"(?i)^\s*(POINT|LINESTRING|MULTILINESTRING)\s*\([-+0-9.eE,()\s]+\)\s*$")
    parts = F.regexp_extract_all(body, F.lit(r"([-+0-9.E][-+0-9.E,\s]*)"), F.lit(1))
    number = lambda p, i: F.element_at(F.split(F.trim(p), r"\s+"), i).try_cast("double")
    lines = F.transform(F.filter(parts, lambda x: F.trim(F.replace(x, F.lit(","), F.lit(""))) != ""), lambda l: F.transform(F.split(F.trim(l), r"\s*,\s*"), lambda p: F.struct(number(p, 1).alias("lng"), number(p, 2).alias("lat"))))  # noqa: E741
    return F.when(sound, lines)


def results(rows: DataFrame) -> DataFrame:
    """The result columns of an import; coordinates only where the address is resolved."""
    seen = lambda c: F.when(F.col("status") == "RESOLVED", F.col(c))
    return rows.select("external_id", "address", "district", "status", "decision", "precision_level", seen("lat").alias("lat"), seen("lng").alias("lng"), "ubigeo", "canonical_address", "ticket_id", F.array_join("flags", ";").alias("flags"))


def wkt_lines(lines: Column) -> Column:
    """MULTILINESTRING text of lines, arrays of (lng, lat)."""
    point = lambda p: F.format_string("%.6f %.6f", p["lng"], p["lat"])
    each = F.transform(lines, lambda l: F.concat(F.lit("("), F.array_join(F.transform(l, point), ","), F.lit(")")))  # noqa: E741
    return F.concat(F.lit("MULTILINESTRING("), F.array_join(each, ","), F.lit(")"))


def geojson_polygon(rings: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["lng"], p["lat"]))).alias("coordinates")))


def first_sheet(path: str) -> list[list[str]]:
    """Rows of a workbook's first sheet: shared and inline strings, cells placed by their reference."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{ns}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{ns}c"):
                at = 0
                for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                kind, value = c.get("t"), c.find(f"{ns}v")
                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if kind == "inlineStr" else (value.text or "") if value is not None else ""
                cells[max(0, at - 1) if at else len(cells)] = strings[int(text)] if kind == "s" and text else text
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def publish(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Write a gazetteer's tables under ``version=...``; the version counts once its marker table is written, last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, n) for n in tables], "version string, name string").coalesce(1).write.mode("append").parquet(f"{root}/_published")
    return version


def latest(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest published version."""
    return latest_version(spark, root)[1]


def latest_version(spark: SparkSession, root: str) -> tuple[str, dict[str, DataFrame]]:
    """The newest published version and its tables."""
    marks = spark.read.schema("version string, name string").parquet(f"{root}/_published")
    version = marks.agg(F.max("version")).first()[0]
    return version, {r.name: spark.read.parquet(f"{root}/version={version}/{r.name}") for r in marks.where(F.col("version") == version).select("name").distinct().collect()}
