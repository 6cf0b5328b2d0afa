"""An invented gazetteer of four streets, and what each address must come to."""

import pytest
from pyspark.sql import functions as F

from callejero.functions import text as T
from callejero.operators import locate as loc, synth
from callejero.operators.geocode import geocode, published
from callejero.operators.normalize import normalize

ENTRIES = [
    {"code": "150116", "department": "Lima", "province": "Lima", "district": "Lince", "zone": "LIMA", "aliases": []},
    {"code": "070102", "department": "Callao", "province": "Callao", "district": "Bellavista", "zone": "CALLAO", "aliases": []},
]
STREETS = [(1, "AVENIDA", "LAS PALMERAS"), (2, "AVENIDA", "LOS CEREZOS"), (3, "CALLE", "LOS NARANJOS"), (4, "CALLE", "LOS NARANJOS")]
LINES = [(1, -77.04, -12.08, -77.039, -12.08), (2, -77.05, -12.07, -77.03, -12.07), (3, -77.045, -12.085, -77.0445, -12.085), (4, -77.035, -12.075, -77.0345, -12.075)]
ANCHORS = [(1, 100, -77.04, -12.08), (1, 120, -77.0398, -12.08), (1, 140, -77.0396, -12.08), (3, 200, -77.045, -12.085), (3, 220, -77.0448, -12.085), (4, 800, -77.035, -12.075), (4, 820, -77.0348, -12.075)]
CASES = [
    ("Av. Las Palmeras 120", "AUTO_ACCEPT", "ADDRESS_POINT", "", 1),
    ("Av. Las Palmeras 130", "AUTO_ACCEPT", "SEGMENT_INTERPOLATED", "", 1),
    ("Av. Los Cerezos 500", "REVIEW", "STREET", "LONG_STREET_WITHOUT_ANCHOR", 2),
    ("Calle Los Naranjos 810", "AUTO_ACCEPT", "SEGMENT_INTERPOLATED", "STREET_BY_NUMBER_COVERAGE", 4),
    ("Calle Los Naranjos", "REVIEW", "STREET", "AMBIGUOUS_STREET", None),
    ("Calle Los Naranjos, Urb. Los Jardines Inventados", "ACCEPT_FLAGGED", "STREET", "STREET_BY_AREA", 4),
    ("Av. Las Palmeras 190", "REVIEW", "STREET", "EXTRAPOLATED_FROM_ANCHORS", 1),
    ("Av. Las Palmeraz 120", "ACCEPT_FLAGGED", "ADDRESS_POINT", "", 1),
    ("Av. Palmeras 120", "ACCEPT_FLAGGED", "ADDRESS_POINT", "", 1),
    ("Jr. Inventado 10", "REVIEW", "DISTRICT", "STREET_NOT_FOUND", None),
    ("Mz A Lt 3 Urb. Los Jardines Inventados", "ACCEPT_FLAGGED", "ZONE", "", None),
    ("Calle Verificada 77", "AUTO_ACCEPT", "ADDRESS_POINT", "VERIFIED_OPERATOR_PIN", None),
]


def gazetteer(spark):
    make = spark.createDataFrame
    streets = make([(i, "150116", t, n, n) for i, t, n in STREETS], "street_id long, ubigeo string, type string, name string, key string")
    streets = streets.withColumn("aliases", F.array().cast("array<string>")).withColumn("promoted", F.array().cast("array<string>"))
    segments = make([(i, 0, 0, *p) for i, *p in LINES], "street_id long, line_id long, seg int, lng0 double, lat0 double, lng1 double, lat1 double")
    anchors = make(ANCHORS, "street_id long, number int, lng double, lat double")
    return dict(
        streets=streets, segments=segments, anchors=anchors, crossings=make([], "street_id long, lng double, lat double"), marks=make([], "street_id long, hundred int, lng double, lat double"),
        hints=make([], "street_id long, number int, lng double, lat double"), areas=make([("150116", "LOS JARDINES INVENTADOS", -77.0348, -12.0752)], "ubigeo string, key string, lng double, lat double"),
        verified=make([("CALLE|VERIFICADA|77", "150116", -77.03, -12.07, "operator_pin")], "k string, u string, lng double, lat double, method string").select(T.address_hash(F.col("k"), F.col("u")).alias("address_hash"), "lng", "lat", "method"),
        centroids=make([("150116", -77.036, -12.083)], "ubigeo string, lng double, lat double"),
    )


def tables(spark):
    g = gazetteer(spark)
    verified = g.pop("verified")
    return dict(g=published(**g), verified=verified)


@pytest.fixture(scope="module")
def answers(spark):
    rows = [(i, a, "Lince", "") for i, (a, *_) in enumerate(CASES)] + [(100, "Av. Los Olivos 100", "Bellavista", "Callao"), (101, "Calle Sin Distrito 5", None, None), (102, None, "Lince", None)]
    read = normalize(spark.createDataFrame(rows, "req_id long, address string, district string, province string"), ENTRIES, frozenset({"LIMA"}))
    return {r.req_id: r for r in geocode(read, **tables(spark)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_decisions(answers, i):
    address, decision, precision, flag, street = CASES[i]
    r = answers[i]
    assert (r.decision, r.precision) == (decision, precision), address
    assert not flag or flag in r.flags
    assert street is None or r.street_id == street
    assert r.lng is not None and r.lat is not None


def test_number_between_its_neighbours(answers):
    assert -77.0398 < answers[1].lng < -77.0396


def test_scope(answers):
    assert (answers[100].decision, answers[100].status, answers[100].lng) == ("REJECT", "OUT_OF_SCOPE", None)
    assert (answers[101].status, answers[101].reason) == ("REVIEW_REQUIRED", "sin distrito")
    assert answers[102].precision == "DISTRICT"


def test_every_request_once(answers):
    assert len(answers) == len(CASES) + 3


def place(spark, num, crossings=(), marks=(), hints=(), anchors=(), near=(None, None)):
    g = gazetteer(spark)
    make = spark.createDataFrame
    at = lambda rows, columns: make(list(rows), columns)
    r = make([(1, 2, num, *near)], "req_id long, street_id long, num int, near_lng double, near_lat double")
    found = loc.on_street(r, loc.prepared(
        g["segments"], at(anchors, "street_id long, number int, lng double, lat double"), at(crossings, "street_id long, lng double, lat double"),
        at(marks, "street_id long, hundred int, lng double, lat double"), at(hints, "street_id long, number int, lng double, lat double"),
    ))
    return found.first()


CORNERS = [(2, -77.05 + 0.002 * i, -12.07) for i in range(1, 10)]


def test_marked_blocks(spark):
    marks = [(2, 3, -77.043, -12.07), (2, 4, -77.041, -12.07)]
    r = place(spark, 350, CORNERS, marks)
    assert (r.note, r.precision) == ("BLOCK_RANGE", "SEGMENT_INTERPOLATED") and -77.044 < r.lng < -77.042
    r = place(spark, 750, CORNERS, marks)
    assert (r.note, r.precision) == ("BLOCK_SEQUENCE_FAR", "STREET") and -77.036 < r.lng < -77.034


def test_parallel_blocks(spark):
    hints = [(2, 310, -77.0435, -12.07), (2, 410, -77.0415, -12.07)]
    assert place(spark, 350, CORNERS, hints=hints).note == "PARALLEL_BLOCKS"


def test_near_area_and_middle(spark):
    r = place(spark, None, near=(-77.04, -12.071))
    assert r.note == "STREET_NEAR_AREA" and abs(r.lng + 77.04) < 1e-6
    assert (place(spark, None).note, place(spark, None).tight) == ("", False)


def test_area_in_the_pair_s_row(spark):
    """Each pair of an address and a street has its distance from the named area without a join back by the pair; a pair without an area has none."""
    g = gazetteer(spark)
    make = spark.createDataFrame
    tables = loc.prepared(g["segments"], g["anchors"], g["crossings"], g["marks"], g["hints"])
    pairs = make([(1, 2, None, -77.04, -12.071), (2, 2, None, None, None), (3, 4, 810, -77.0348, -12.0752), (4, 1, 900, -77.2, -12.3), (5, 99, None, -77.04, -12.071)], "pair long, street_id long, num int, near_lng double, near_lat double")
    found = loc.on_street(pairs, tables)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join [street_id" in plan and "Join [pair" not in plan
    rows = {r.pair: r for r in found.collect()}
    off = {r.req_id: r.metres for r in loc.nearest_of_street(pairs.withColumnRenamed("pair", "req_id"), g["segments"]).collect()}
    assert set(rows) == {1, 2, 3, 4} and {i: r.area_m for i, r in rows.items() if r.area_m is not None} == off and set(off) == {1, 3, 4}
    assert [rows[i].note for i in (1, 2, 3)] == ["STREET_NEAR_AREA", "", ""] and rows[3].precision == "SEGMENT_INTERPOLATED"


def test_side_of_the_street(spark):
    anchors = [(2, 100, -77.049, -12.0699), (2, 300, -77.045, -12.0699), (2, 101, -77.0489, -12.0701)]
    r = place(spark, 340, anchors=anchors)
    assert r.note == "EXTRAPOLATED_FROM_ANCHORS" and abs(r.lat + 12.0699) < 1e-6


def test_clean_areas(spark):
    names = spark.createDataFrame([("BRENA",)], "key string")
    own = spark.createDataFrame([("070104", "LA PERLA")], "ubigeo string, key string")
    rows = [
        (1, "Urb. Los Ñandúes", "070104", 1), (2, "Los Ñandúes", "070104", 1), (3, "Urb.Los Ñandúes", "070104", 1), (4, "Breña", "070104", 1), (5, "Unidad La Perla", "070104", 1),
        (6, "Villa de La Perla", "070104", 1), (7, "Pueblo Joven Tercera Etapa", "070104", 1), (8, "Quinta Heren", "070104", 2), (9, "Casa Lote 3", "070104", 1), (10, None, None, 1), (11, "Urb. 3ra Quinta", None, None),
        (1, "Urb. Los Ñandúes", "070104", 1), (12, "x" * 100_000, "070104", 1),
    ]
    got = synth.clean_areas(spark.createDataFrame(rows, "area_id int, name string, ubigeo string, n_districts int"), names, own).collect()
    assert len(got) == len(rows)
    reasons = {r.area_id: r.reason for r in got}
    assert reasons == {
        1: "", 2: "duplicado", 3: "puntuacion_ambigua", 4: "nombre_de_distrito", 5: "nombre_con_su_distrito", 6: "", 7: "", 8: "fuera_o_en_borde", 9: "palabra_que_cambia_el_parseo", 10: "", 11: "fuera_o_en_borde", 12: "",
    }
    by = {r.area_id: (r.marker, r.name, r.expected) for r in got}
    assert by[1] == ("URBANIZACION", "Los Ñandúes", "URBANIZACION LOS ÑANDUES")
    assert by[7] == ("PUEBLO JOVEN", "Tercera Etapa", "PUEBLO JOVEN 3 ETAPA")
    assert by[3] == (None, None, None)
    none = spark.createDataFrame([], "area_id int, name string, ubigeo string, n_districts int")
    assert synth.clean_areas(none, names.limit(0), own.limit(0)).count() == 0
