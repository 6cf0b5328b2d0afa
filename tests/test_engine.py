import random

import duckdb
import pytest
from pyspark.sql import functions as F

from callejero.functions import geo, text as T
from callejero.operators import build as gazetteer_build, gazetteer as gaz, locate as loc, truth
from callejero.plans import build, desk, evaluate, queries as plans, rules  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_oracle(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    want = db.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    cols = sorted(df.columns)
    got = sorted((tuple(near(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(near(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_blocks():
    cuts, anchors = [100.0 * i for i in range(1, 8)], [(210, 210.0), (250, 250.0), (290, 290.0), (310, 310.0)]
    b = loc.Blocks(0.0, 800.0, cuts, anchors, [])
    assert b.place(350)[1] and 300 < b.place(350)[0] < 400
    at, sure = b.place(650)
    assert not sure and 600 < at < 700
    assert loc.Blocks(0.0, 800.0, cuts, [], [(3, 350.0)]).place(340) == (350.0, True)
    split = loc.Blocks(0.0, 300.0, [150.0], [], [(1, 20.0), (2, 100.0)])
    assert 60.0 in split.bounds


def test_rings():
    square = [[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 1), (0, 0)]]
    ring = geo.assemble_rings(square)[0]
    assert ring[0] == ring[-1] and len(ring) == 5
    with pytest.raises(ValueError):
        geo.assemble_rings(square[:2])
    assert len(geo.simplify([(0, 0), (0.5, 0.0001), (1, 0), (1, 1), (0, 1), (0, 0)], 0.01)) == 5


BASE, NEAR, FAR = (-77.03, -12.08), (-77.03005, -12.08005), (-77.029, -12.08)


@pytest.mark.parametrize(
    "deliveries, quality, reason",
    [
        ([("d1", BASE, (-77.0299, -12.08), 1), ("d2", NEAR, BASE, 1)], "oro", "entregas_coinciden_en_dias_distintos"),
        ([("d1", BASE, NEAR, 1)], "plata", "una_sola_fecha"),
        ([("d1", BASE, FAR, 1)], "", "sin_entregas_validas:lejos_de_la_llegada"),
        ([("d1", (-77.10, -12.08), (-77.10004, -12.08), 1)], "", "sin_entregas_validas:fuera_del_distrito"),
        ([("d1", BASE, NEAR, 1), ("d2", FAR, (-77.0291, -12.08), 1)], "", "entregas_contradictorias"),
        ([("d1", BASE, None, 1)], "", "sin_entregas_validas:sin_llegada"),
        ([("d1", BASE, BASE, 1)], "", "sin_entregas_validas:llegada_identica"),
        ([("d1", BASE, NEAR, 3)], "", "sin_entregas_validas:marcada_en_lote"),
        ([("d1", BASE, NEAR, 2)], "plata", "una_sola_fecha"),
    ],
)
def test_truth(spark, deliveries, quality, reason):
    rows = [(i, 1, day, p[0], p[1], a and a[0], a and a[1], batch, p[0] > -77.05) for i, (day, p, a, batch) in enumerate(deliveries)]
    df = spark.createDataFrame(rows, "delivery_id long, addr_key long, day string, lng double, lat double, arr_lng double, arr_lat double, batch int, in_district boolean")
    r = truth.resolve(truth.judged(df)).first()
    assert (r.quality, r.reason) == (quality, reason)


def test_medoid_of_many_points(spark):
    """A busy address by cells and bounds gives the same as by comparing all in an array."""
    rng = random.Random(5)
    rows = []
    for addr, spread, n in ((1, 1e-4, 900), (2, 2.5e-5, 400), (3, 9e-4, 300), (4, 1e-6, 5), (5, 1.2e-4, 700)):
        for i in range(n):
            x, y = rng.gauss(0, 1) * spread, rng.uniform(-1, 1) * spread
            rows.append((addr * 10_000 + i, addr, -77.0 + (round(x, 6) if i % 3 else x), -12.0 + (round(y, 6) if i % 3 else y)))
    df = spark.createDataFrame(rows, "delivery_id long, addr_key long, lng double, lat double")
    by_cells, by_array = ({r.addr_key: r for r in truth.medoids(df, few).collect()} for few in (0, 1_000_000))
    assert by_cells == by_array and len(by_cells) == 5 and not by_cells[2].far and by_cells[3].far


def test_batch_counts(spark):
    rows = [(0, "x", 1, *BASE), (1, "y", 1, *NEAR), (2, "x", 1, *BASE), (3, "z", 2, *BASE), (4, "w", 1, -76.9, -12.0)]
    df = spark.createDataFrame(rows, "delivery_id long, addr_key string, day int, lng double, lat double")
    assert [r.batch - 1 for r in truth.batch_counts(df).orderBy("delivery_id").collect()] == [1, 2, 1, 0, 0]


def test_batch_counts_of_one_place(spark):
    """A day's deliveries at one place meet as one row, not in pairs: 200,000 of them would be 40,000,000,000."""
    i = F.col("id")
    df = spark.range(200_000).select(i.alias("delivery_id"), F.when(i % 4 != 3, i % 4).alias("addr_key"), F.lit(1).alias("day"), F.when(i % 8 != 2, -77.0).alias("lng"), F.lit(-12.0).alias("lat"))
    got = truth.batch_counts(df).groupBy(F.pmod("delivery_id", F.lit(8)).alias("k")).agg(F.min("batch").alias("lo"), F.max("batch").alias("hi")).orderBy("k").collect()
    # Those of address 2 without a place count for none; nor do those without address.
    assert [(r.lo, r.hi) for r in got] == [(n, n) for n in (75_001, 75_001, 1, 1, 75_001, 75_001, 100_001, 1)]


def test_batch_counts_by_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(9), rng.randrange(2), -77.0 + rng.randrange(12) * 1.1e-4, -12.0 + rng.randrange(9) * 1.3e-4) for i in range(400)]
    df = spark.createDataFrame(rows, "delivery_id long, addr_key long, day int, lng double, lat double")
    apart = geo.distance(*[F.col(c) for c in ("a.lng", "a.lat", "b.lng", "b.lat")])
    pairs = df.alias("a").join(df.alias("b"), (F.col("a.day") == F.col("b.day")) & (F.col("a.addr_key") != F.col("b.addr_key")) & (apart <= truth.CLUSTER_M))
    want = {r.delivery_id: r["count"] for r in pairs.groupBy("a.delivery_id").count().collect()}
    assert {r.delivery_id: r.batch - 1 for r in truth.batch_counts(df).collect()} == {i: want.get(i, 0) for i in range(400)}


@pytest.mark.parametrize("name", ["district_locate", "edit_validation", "nearest_on_street", "pin_alerts", "parallel_hints"])
def test_anchors_meet_streets_by_key(spark, name):
    """The anchors' view holds no join of all pairs of parts and streets; its oracles keep their SQL."""
    import __spark_entry__
    from callejero.plans import fixtures as X

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    assert not any("NestedLoopJoin" in line and " = " in line for line in plan.splitlines()) and X.MATCHED in __spark_entry__.oracle_sql()[name]


def test_nearest_of_many_segments(spark):
    """A street's nearest place over one, many or no segments is that of all its segments compared one by one; points without a place have none."""
    rng = random.Random(5)
    at = lambda: (-77.0 + rng.random() * 0.01, -12.0 + rng.random() * 0.01)
    segments = [(i, k // 3, k % 3, *at(), *at()) for i in range(6) for k in range(i * i)] + [(6, 0, 0, -77.0, -12.0, -77.0, -12.0)]
    points = [(i, i % 8, *at()) for i in range(80)] + [(80, 2, None, None)]
    s = spark.createDataFrame(segments, "street_id long, line_id long, seg int, lng0 double, lat0 double, lng1 double, lat1 double")
    p = spark.createDataFrame(points, "req_id long, street_id long, near_lng double, near_lat double")
    near = geo.nearest_on_segment(*[F.col(c) for c in ("near_lng", "near_lat", *loc.SEGMENT)])
    want = p.where("near_lng IS NOT NULL").join(s, "street_id").groupBy("req_id").agg(F.min(near).alias("n")).select("req_id", "n.*")
    rows = lambda d: sorted((r.req_id, *(round(x, 9) for x in r[1:])) for r in d.collect())
    assert rows(loc.nearest_of_street(p, s)) == rows(want) and want.count() == 60


@pytest.mark.parametrize("name", ["nearest_on_street", "edit_validation", "pin_alerts"])
def test_points_are_not_grouped(spark, name):
    """A point meets its street's segments in one row, so points are not shuffled by their id to find the nearest."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(street_id" in plan and "hashpartitioning(req_id" not in plan and "hashpartitioning(edit_id" not in plan


def _crooked(spark):
    """Streets of no, one or several segments, one of them a single point, and anchors around them."""
    rng = random.Random(3)
    streets = {i: (-77.0 + rng.random() * 0.01, -12.0 + rng.random() * 0.01, rng.uniform(-0.3, 0.3)) for i in range(30)}
    segments = [(i, k // 2, k % 2, x + k * 9e-4, y + k * 9e-4 * a, x + (k + 1) * 9e-4, y + (k + 1) * 9e-4 * a) for i, (x, y, a) in streets.items() for k in range(i % 5)] + [(29, 9, 0, -77.0, -12.0, -77.0, -12.0)]
    anchors = [(n, n % 30, n % 97 + 1, streets[n % 30][0] + rng.random() * 3e-3, streets[n % 30][1] + rng.uniform(-1, 1) * 4e-4) for n in range(900)]
    s = spark.createDataFrame(segments, "street_id long, line_id long, seg int, lng0 double, lat0 double, lng1 double, lat1 double")
    return s, spark.createDataFrame(anchors, "anchor_id long, street_id long, number int, lng double, lat double")


def test_hints_by_pairs(spark):
    """Cells leave no anchor out: hints are those of all pairs of a street and an anchor, and no row of theirs is shuffled once a pair has met."""
    s, a = _crooked(spark)
    axis = loc.frames(s)
    mine, own = axis.select("street_id", "angle", "mx", "my", "lo", "hi"), axis.select(F.col("street_id").alias("owner"), F.col("angle").alias("own_angle"))
    pairs = mine.crossJoin(a.withColumnRenamed("street_id", "owner").join(own, "owner")).where("street_id <> owner").where(F.abs(F.cos(F.col("angle") - F.col("own_angle"))) >= loc.PARALLEL_COS)
    pairs = pairs.where(F.round(geo.on_axis(F.col("lng"), F.col("lat"))[0], 6).between(F.round("lo", 6), F.round("hi", 6))).join(s, "street_id")
    near = pairs.groupBy("street_id", "anchor_id", "number").agg(F.min(geo.nearest_on_segment(*[F.col(c) for c in ("lng", "lat", *loc.SEGMENT)])).alias("n")).where(F.col("n.metres") <= loc.LATERAL_M)
    rows = lambda d: sorted((r.street_id, r.anchor_id, r.number, round(r.lng, 9), round(r.lat, 9)) for r in d.collect())
    found = loc.parallel_hints(s, a)
    assert rows(found) == rows(near.select("street_id", "anchor_id", "number", "n.*")) and near.count() > 500
    assert "hashpartitioning(street_id, anchor_id" not in (plan := found._jdf.queryExecution().executedPlan().toString().replace("#", " ")) and "anchor_id" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)


def test_gathered_hints(spark):
    """Hints gathered in one pass tell what the chain and the offsets tell row by row, on the street's segment that reaches nearest to a chainage."""
    s, a = _crooked(spark)
    axis = loc.frames(s)
    lines = loc.with_segments(axis, s)
    got = {r.street_id: r for r in loc.gathered_hints(a, lines).collect()}
    chain = {}
    for r in loc.chained(a.select("street_id", "number", "lng", "lat"), axis).collect():
        chain.setdefault(r.street_id, []).append((r.number, round(r.chainage, 6)))
    assert {i: [(x.number, round(x.chainage, 6)) for x in r.number_chainage] for i, r in got.items()} == {i: sorted(v) for i, v in chain.items()}
    j = loc.chained(a.select("anchor_id", "street_id", "number", "lng", "lat"), axis).join(axis, "street_id").join(s, "street_id")
    c = F.greatest("lo", F.least("hi", "chainage"))
    c0, c1 = (geo.on_axis(F.col(f"lng{i}"), F.col(f"lat{i}"))[0] for i in (0, 1))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(c - c0, c1 - c0), F.lit(0.0))))
    at = geo.on_axis(F.col("lng0") + t * (F.col("lng1") - F.col("lng0")), F.col("lat0") + t * (F.col("lat1") - F.col("lat0")))[1]
    d = j.groupBy("anchor_id", "street_id", "number").agg(F.min_by(geo.on_axis(F.col("lng"), F.col("lat"))[1] - at, F.struct(F.round(F.abs(c - (c0 + t * (c1 - c0))), 6), "line_id", "seg")).alias("off"))
    offs = {}
    for r in d.collect():
        offs.setdefault((r.street_id, r.number % 2), []).append(r.off)
    want = {k: round(max(-40.0, min(40.0, sorted(v)[len(v) // 2])), 6) for k, v in offs.items()}
    assert {(i, x.side): round(x.offset, 6) for i, r in got.items() for x in r.sides} == want
    assert {(r.street_id, r.side): round(r.offset, 6) for r in loc.side_offsets(a, s, axis).collect()} == want and len(want) > 40


def test_attach_by_pairs(spark):
    """Streets of one name meet points in cells alone, and give what all pairs give: the own type first, if it exists anywhere."""
    rng = random.Random(11)
    streets = [(i, "u", f"K{i % 2}", ("A", "B", "")[i % 3] if i % 2 else "A", *(x := (-77.0 + rng.random() * 0.02, -12.0 + rng.random() * 0.02)), x[0] + rng.uniform(-1, 1) * 6e-3, x[1] + rng.uniform(-1, 1) * 6e-3) for i in range(60)]
    points = [(i, "u", f"K{i % 3}", ("A", "B", "C")[i % 7 % 3], -77.0 + rng.random() * 0.02, -12.0 + rng.random() * 0.02) for i in range(300)]
    s = spark.createDataFrame(streets, "street_id long, ubigeo string, key string, type string, lng0 double, lat0 double, lng1 double, lat1 double")
    p = spark.createDataFrame(points, "point_id long, ubigeo string, key string, type string, lng double, lat double")
    d = geo.segment_distance(*[F.col(c) for c in ("lng", "lat", "lng0", "lat0", "lng1", "lat1")])
    pairs = p.join(s.withColumnRenamed("type", "s_type"), ["ubigeo", "key"]).select("point_id", F.struct(F.col("type") != F.col("s_type"), F.round(d, 6).alias("m"), "street_id").alias("r"))
    want = {r.point_id: r.r.street_id for r in pairs.groupBy("point_id").agg(F.min("r").alias("r")).collect() if r.r.m <= gaz.ATTACH_M}
    found = gaz.attach(p, s)
    assert {r.point_id: r.street_id for r in found.collect()} == want and len(want) > 50
    assert "cx" in found._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("bits, alike", [(9, 1), (11, 1), (30, 400)])
def test_stable_ids_in_order(spark, monkeypatch, bits, alike):
    """Each street takes the first free number from its hash on, in order of pos; streets of one hash take no round each."""
    i = F.col("id")
    s = spark.range(400).select((i * 7 % 400).alias("pos"), F.lit("u").alias("ubigeo"), F.lit("t").alias("type"), F.lit("k").alias("key"), F.array(F.floor(i / alike).cast("string")).alias("refs"))
    hi, _ = T.fnv1a(F.concat_ws("|", "ubigeo", "type", "key", s["refs"][0]))
    taken, want = set(), {}
    for r in s.select("pos", F.shiftright(hi, 32 - bits).alias("h")).orderBy("pos").collect():
        at = max(1, r.h)
        while at in taken:
            at += 1
        taken.add(at)
        want[r.pos] = at
    stores, real = [], gazetteer_build.stored
    monkeypatch.setattr(gazetteer_build, "stored", lambda df, label: stores.append(label) or real(df, label))
    assert {r.pos: r.street_id for r in gazetteer_build.stable_ids(s, bits).collect()} == want and len(stores) <= 2


@pytest.mark.parametrize("bits", [6, 9, 30])
def test_stable_ids_where_pos_repeats(spark, bits):
    """Streets whose pos occurs twice or is null are there once each, with a number of their own."""
    i = F.col("id") % 20
    s = spark.range(50).select(F.when(i > 1, i).alias("pos"), F.lit("u").alias("ubigeo"), F.lit("t").alias("type"), F.lit("k").alias("key"), F.array(F.when(i > 1, i).otherwise(0).cast("string")).alias("refs"))
    hi, _ = T.fnv1a(F.concat_ws("|", "ubigeo", "type", "key", s["refs"][0]))
    taken, want = set(), []
    for r in s.select("pos", F.shiftright(hi, 32 - bits).alias("h")).orderBy(F.asc_nulls_last("pos")).collect():
        at = max(1, r.h)
        while at in taken:
            at += 1
        taken.add(at)
        want.append((r.pos, at))
    got = gazetteer_build.stable_ids(s, bits)
    assert got.columns == [*s.columns, "street_id"]
    assert sorted(((r.pos, r.street_id) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_stable_street_ids_of_repeated_keys(spark, tmp_path):
    """A supplier's key that occurs twice or is null is a row each time, as in the SQL."""
    con = duckdb.connect()
    rows = f"SELECT CASE WHEN s_suppkey IN (7, 8, 9) THEN NULL ELSE s_suppkey END AS s_suppkey, s_name, s_nationkey, s_acctbal FROM '{SF}/supplier.parquet' UNION ALL SELECT * FROM '{SF}/supplier.parquet'"
    con.execute(f"COPY ({rows}) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    got = [tuple(r) for r in plans.QUERIES["stable_street_ids"](spark, str(tmp_path)).select("pos", "street_id").collect()]
    assert sorted(got, key=repr) == sorted(con.execute(plans.ORACLES["stable_street_ids"]).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["street_candidates_topk", "street_pick", "street_candidates"])
def test_streets_sought_once_a_name(spark, monkeypatch, name):
    """Requests of one name share its candidates: these are found, ranked and picked once, then given to all."""
    seen, real = [], plans.res.candidates
    monkeypatch.setattr(plans.res, "candidates", lambda requests, streets: seen.append(requests.count()) or real(requests, streets))
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > len(plans.X.ASKED) == seen[0]


def test_distance(spark):
    d = spark.range(1).select(geo.distance(F.lit(-77.0), F.lit(-12.0), F.lit(-77.0), F.lit(-12.001)).alias("d")).first().d
    assert abs(d - 111.19) < 0.1


def test_entry_without_corpus_package():
    import __spark_entry__

    assert "street_match_exact" in __spark_entry__.queries()
