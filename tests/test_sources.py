import json
import zipfile

from pyspark.sql import functions as F

from callejero.sources import files
from callejero.streaming import events


def test_import_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Direccion,distrito\n1,Av. X 10,Lince\n2,,\n")
    rows = files.import_csv(spark, str(tmp_path / "a.csv")).orderBy("external_id").collect()
    assert (rows[0].address, rows[0].district, rows[0].number) == ("Av. X 10", "Lince", "") and rows[1].address == ""


def test_gps_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text(",".join(files.GPS) + "\n" + "1,a,,,,,,150101,2024-01-02,-12.0,-77.0\n" + "2,a,,,,,,150101,2024-01-02,x,-77.0\n")
    rows = files.gps_csv(spark, str(tmp_path / "g.csv")).collect()
    assert len(rows) == 1 and rows[0].lat == -12.0 and rows[0].arr_lat is None


def test_osm_and_polygons(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "way", "id": 7, "tags": {"name": "X"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}]}]}))
    assert files.osm_elements(spark, str(tmp_path / "o.json")).first().tags["name"] == "X"
    (tmp_path / "d.json").write_text(json.dumps({"districts": [{"ubigeo": "150101", "name": "L", "osm_relation": 1, "rings": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}]}))
    ring = files.district_polygons(spark, str(tmp_path / "d.json"))
    assert ring.first().points[1].lng == 1.0
    text = ring.select(files.wkt_lines(F.array("points")).alias("w"), files.geojson_polygon(F.array("points")).alias("g")).first()
    assert text.w.startswith("MULTILINESTRING((0.000000 0.000000,1.0") and json.loads(text.g)["coordinates"][0][1] == [1.0, 0.0]


def test_workbook(tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>uno</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>dos</t></is></c></row></sheetData></worksheet>')
    assert files.first_sheet(str(tmp_path / "w.xlsx")) == [["uno", "", "dos"]]


def test_publish(spark, tmp_path):
    files.publish({"street": spark.range(2)}, str(tmp_path / "s"), "1")
    files.publish({"street": spark.range(3)}, str(tmp_path / "s"), "2")
    assert files.latest(spark, str(tmp_path / "s"))["street"].count() == 3


def test_streams(spark, tmp_path):
    schema = "time timestamp, client string, key string, request_id long, decision string, precision_level string, address string"
    rows = [(f"2024-01-01 00:00:0{i // 4}", "a", f"k{i % 5}", i, "REVIEW", "STREET", "secret street 1") for i in range(8)]
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("time", F.to_timestamp("time")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    events.event_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    out = spark.read.json(str(tmp_path / "out"))
    assert out.count() == 8 and "address" not in out.columns

    def gathered(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    assert gathered(events.replay_protected(stream), "once").count() == 5
    assert gathered(events.decision_counters(stream), "counted", "complete").first().n == 8
    limited = gathered(events.rate_limited(stream, 1.0), "limited").orderBy("request_id").collect()
    assert [r.allowed for r in limited] == [True, True, False, False, True, False, False, False]
