"""Geometry on WGS84 points (lng, lat) as columns: equirectangular, metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6_371_000.0
#: A degree of latitude in metres.
DEGREE_M = RADIUS * math.pi / 180
#: Side of the cells in which points meet edges, in degrees (some 2 km).
CELL = 0.02


def distance(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    x = F.radians(lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return RADIUS * F.sqrt(x * x + y * y)


def _share(ax: Column, ay: Column, dx: Column, dy: Column) -> Column:
    """How far along a segment from (ax, ay) by (dx, dy) the place nearest to the origin lies, 0 to 1."""
    n = dx * dx + dy * dy
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.when(n == 0, 1.0).otherwise(n))))


def _foot(lng: Column, lat: Column, lng0: Column, lat0: Column, lng1: Column, lat1: Column) -> tuple[Column, Column, Column]:
    """How far along a segment the point nearest to a point lies (0 to 1), and its offset in metres, in a plane laid at the point."""
    k, scale = F.cos(F.radians(lat)), RADIUS * math.pi / 180
    ax, ay, bx, by = (lng0 - lng) * k * scale, (lat0 - lat) * scale, (lng1 - lng) * k * scale, (lat1 - lat) * scale
    dx, dy = bx - ax, by - ay
    t = _share(ax, ay, dx, dy)
    return t, ax + t * dx, ay + t * dy


def segment_distance(lng: Column, lat: Column, lng0: Column, lat0: Column, lng1: Column, lat1: Column) -> Column:
    """From a point to a segment."""
    _, x, y = _foot(lng, lat, lng0, lat0, lng1, lat1)
    return F.sqrt(x * x + y * y)


def nearest_on_segment(lng: Column, lat: Column, lng0: Column, lat0: Column, lng1: Column, lat1: Column) -> Column:
    """metres, lng, lat of the segment's point nearest to a point; ordered by distance."""
    t, x, y = _foot(lng, lat, lng0, lat0, lng1, lat1)
    return F.struct(F.sqrt(x * x + y * y).alias("metres"), (lng0 + t * (lng1 - lng0)).alias("lng"), (lat0 + t * (lat1 - lat0)).alias("lat"))


def nearest_on_segments(lng: Column, lat: Column, segs: Column) -> Column:
    """As ``nearest_on_segment``, of the nearest segment in an array of structs with lng0, lat0, lng1, lat1; null where there is none."""
    k, scale = F.cos(F.radians(lat)), RADIUS * math.pi / 180
    # Steps are nested, as a lambda computes each expression as often as it is named.
    laid = F.transform(segs, lambda s: F.struct(s.alias("s"), ((s["lng0"] - lng) * k * scale).alias("ax"), ((s["lat0"] - lat) * scale).alias("ay"), ((s["lng1"] - lng) * k * scale).alias("bx"), ((s["lat1"] - lat) * scale).alias("by")))
    gone = F.transform(laid, lambda a: F.struct(a["s"].alias("s"), a["ax"].alias("ax"), a["ay"].alias("ay"), (a["bx"] - a["ax"]).alias("dx"), (a["by"] - a["ay"]).alias("dy")))
    foot = F.transform(gone, lambda a: F.struct(a.alias("a"), _share(a["ax"], a["ay"], a["dx"], a["dy"]).alias("t")))
    at = lambda f, axis: f["a"]["s"][f"{axis}0"] + f["t"] * (f["a"]["s"][f"{axis}1"] - f["a"]["s"][f"{axis}0"])
    off = lambda f, axis: f["a"][f"a{axis}"] + f["t"] * f["a"][f"d{axis}"]
    return F.array_min(F.transform(foot, lambda f: F.struct(F.sqrt(off(f, "x") * off(f, "x") + off(f, "y") * off(f, "y")).alias("metres"), at(f, "lng").alias("lng"), at(f, "lat").alias("lat"))))


def with_nearest(points: DataFrame, lng: str = "lng", lat: str = "lat", segs: str = "segs", name: str = "n") -> DataFrame:
    """``points`` with ``name``: ``nearest_on_segments``. A single segment, as most streets of a small gazetteer have, is computed by plain columns, each once."""
    columns, k, scale, first = points.columns, F.cos(F.radians(lat)), RADIUS * math.pi / 180, F.get(segs, F.lit(0))
    d = points.withColumns({"_s": first, "_k": k})
    d = d.withColumns({"_ax": (F.col("_s.lng0") - F.col(lng)) * F.col("_k") * scale, "_ay": (F.col("_s.lat0") - F.col(lat)) * scale, "_bx": (F.col("_s.lng1") - F.col(lng)) * F.col("_k") * scale, "_by": (F.col("_s.lat1") - F.col(lat)) * scale})
    d = d.withColumns({"_dx": F.col("_bx") - F.col("_ax"), "_dy": F.col("_by") - F.col("_ay")}).withColumn("_t", _share(F.col("_ax"), F.col("_ay"), F.col("_dx"), F.col("_dy")))
    d = d.withColumns({"_x": F.col("_ax") + F.col("_t") * F.col("_dx"), "_y": F.col("_ay") + F.col("_t") * F.col("_dy")})
    at = lambda axis: (F.col(f"_s.{axis}0") + F.col("_t") * (F.col(f"_s.{axis}1") - F.col(f"_s.{axis}0"))).alias(axis)
    one = F.struct(F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")).alias("metres"), at("lng"), at("lat"))
    size = F.size(segs)
    return d.select(*columns, F.when(size == 1, one).when(size > 1, nearest_on_segments(F.col(lng), F.col(lat), F.col(segs))).alias(name))


def edges(rings: DataFrame) -> DataFrame:
    """ubigeo, ring, x0, y0, x1, y1 of (ubigeo, ring, points: closed array of (lng, lat)), with the district's box."""
    of = lambda axis: F.transform("points", lambda p: p.getField(axis))
    box = {f"{end}_{axis}": (F.array_min if end == "min" else F.array_max)(of(axis)) for end in ("min", "max") for axis in ("lng", "lat")}
    boxed = rings.select("ubigeo", "ring", "points", *[v.alias(k) for k, v in box.items()])
    pairs = F.expr("transform(sequence(0, size(points) - 2), i -> struct(points[i].lng AS x0, points[i].lat AS y0, points[i + 1].lng AS x1, points[i + 1].lat AS y1))")
    return boxed.select("ubigeo", "ring", "min_lng", "max_lng", "min_lat", "max_lat", F.inline(pairs))


def crosses(lng: Column, lat: Column) -> Column:
    """Whether an edge counts in the even-odd rule for a point; edges are half open."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return ((y0 > lat) != (y1 > lat)) & (lng < F.try_divide((x1 - x0) * (lat - y0), y1 - y0) + x0)


def locate(points: DataFrame, edge_table: DataFrame, ident: str = "point_id", cell: float = CELL) -> DataFrame:
    """point_id, ubigeo: each district whose even-odd area holds a point.

    An equi-join on grid cells: an edge stands in every cell of its rows that lies in the district's
    box and not beyond the edge's right end, which are the cells from which a ray to the right can
    cross it. Crossings are counted per point and district. Points without a place lie nowhere.
    """
    at = lambda v: F.floor(v / cell)
    span = lambda low, high: F.explode(F.sequence(at(low), at(high)))
    rows = edge_table.select("ubigeo", "min_lng", "x0", "y0", "x1", "y1", span(F.least("y0", "y1"), F.greatest("y0", "y1")).alias("cy"))
    # A crossing's place is rounded, so the right end gets a little room.
    cells = rows.select("ubigeo", "x0", "y0", "x1", "y1", "cy", span(F.col("min_lng"), F.greatest("x0", "x1") + 1e-9).alias("cx"))
    p = points.select(ident, "lng", "lat", at(F.col("lng")).alias("cx"), at(F.col("lat")).alias("cy"))
    met = p.join(cells, ["cx", "cy"]).where(crosses(F.col("lng"), F.col("lat")))
    return met.groupBy(ident, "ubigeo").agg(F.count("*").alias("n")).where("n % 2 = 1").select(ident, "ubigeo")


def only_district(points: DataFrame, edge_table: DataFrame, ident: str = "point_id") -> DataFrame:
    """As ``locate``, for the points that lie in exactly one district."""
    found = locate(points, edge_table, ident)
    return found.groupBy(ident).agg(F.count("*").alias("n"), F.first("ubigeo").alias("ubigeo")).where("n = 1").drop("n")


def touching(lines: DataFrame, edge_table: DataFrame, ident: str = "line_id", cell: float = CELL) -> DataFrame:
    """line_id, ubigeo: each district that a line (line_id, points) touches: one of its points lies inside, or a segment meets an outline.

    Segments and edges meet in the grid cells of their boxes.
    """
    ends = lines.select(ident, F.posexplode("points").alias("i", "p")).select(F.col(ident).alias("_line"), "i", "p.lng", "p.lat").withColumn("_at", F.concat_ws("|", F.col("_line").cast("string"), F.col("i").cast("string")))
    inside = locate(ends, edge_table, "_at", cell).join(ends.select("_at", "_line"), "_at").select("_line", "ubigeo")
    at = lambda v: F.floor(v / cell)
    span = lambda a, b: F.explode(F.sequence(at(F.least(a, b)), at(F.greatest(a, b))))
    pair = F.expr("CASE WHEN size(points) > 1 THEN transform(sequence(0, size(points) - 2), i -> struct(points[i].lng AS a, points[i].lat AS b, points[i + 1].lng AS c, points[i + 1].lat AS d)) ELSE array() END")
    s = lines.select(F.col(ident).alias("_line"), F.inline(pair))
    s = s.select("*", span(F.col("a"), F.col("c")).alias("cx")).select("*", span(F.col("b"), F.col("d")).alias("cy"))
    e = edge_table.select("ubigeo", "x0", "y0", "x1", "y1", span(F.col("x0"), F.col("x1")).alias("cx")).select("*", span(F.col("y0"), F.col("y1")).alias("cy"))
    turn = lambda ax, ay, bx, by, cx, cy: (F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax))
    apart = (turn("a", "b", "c", "d", "x0", "y0") * turn("a", "b", "c", "d", "x1", "y1") > 0) | (turn("x0", "y0", "x1", "y1", "a", "b") * turn("x0", "y0", "x1", "y1", "c", "d") > 0)
    met = s.join(e, ["cx", "cy"]).where(~apart).where((F.greatest("a", "c") >= F.least("x0", "x1")) & (F.greatest("x0", "x1") >= F.least("a", "c")) & (F.greatest("b", "d") >= F.least("y0", "y1")) & (F.greatest("y0", "y1") >= F.least("b", "d")))
    return inside.unionByName(met.select("_line", "ubigeo")).distinct().withColumnRenamed("_line", ident)


def centroids(edge_table: DataFrame) -> DataFrame:
    """ubigeo, lng, lat: the area-weighted centroid of each district's largest ring."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    rings = edge_table.groupBy("ubigeo", "ring").agg(F.sum(cross).alias("a"), F.sum((F.col("x0") + F.col("x1")) * cross).alias("sx"), F.sum((F.col("y0") + F.col("y1")) * cross).alias("sy"))
    best = rings.groupBy("ubigeo").agg(F.max_by(F.struct("a", "sx", "sy"), F.struct(F.abs("a"), -F.col("ring"))).alias("r"))
    return best.select("ubigeo", (F.col("r.sx") / (3 * F.col("r.a"))).alias("lng"), (F.col("r.sy") / (3 * F.col("r.a"))).alias("lat"))


def axes(vertices: DataFrame) -> DataFrame:
    """street_id, angle of the main direction, centre mx and my, extent lo and hi along the direction, from (street_id, lng, lat)."""
    mid = vertices.groupBy("street_id").agg(F.avg("lng").alias("mx"), F.avg("lat").alias("my"))
    k = RADIUS * math.pi / 180
    flat = vertices.join(mid, "street_id").select("street_id", "mx", "my", ((F.col("lng") - F.col("mx")) * F.cos(F.radians("my")) * k).alias("x"), ((F.col("lat") - F.col("my")) * k).alias("y"))
    angle = flat.groupBy("street_id").agg((0.5 * F.atan2(2 * F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x")) - F.sum(F.col("y") * F.col("y")))).alias("angle"))
    along = F.col("x") * F.cos("angle") + F.col("y") * F.sin("angle")
    return flat.join(angle, "street_id").groupBy("street_id", "angle", "mx", "my").agg(F.min(along).alias("lo"), F.max(along).alias("hi"))


def on_axis(lng: Column, lat: Column) -> tuple[Column, Column]:
    """A point's metres along and across its street's axis (the columns of ``axes``)."""
    k = RADIUS * math.pi / 180
    x, y = (lng - F.col("mx")) * F.cos(F.radians("my")) * k, (lat - F.col("my")) * k
    return x * F.cos("angle") + y * F.sin("angle"), y * F.cos("angle") - x * F.sin("angle")


def assemble_rings(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Chain ways end to end, turning them where needed, into closed rings of at least four points."""
    left, rings = [list(w) for w in ways if w], []
    while left:
        ring = left.pop(0)
        while ring[0] != ring[-1]:
            for i, way in enumerate(left):
                if ring[-1] in (way[0], way[-1]):
                    ring += (way if way[0] == ring[-1] else way[::-1])[1:]
                    del left[i]
                    break
            else:
                raise ValueError("a ring does not close")
        if len(ring) >= 4:
            rings.append(ring)
    return rings


def simplify(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker on a closed ring, split at the vertex farthest from the first; kept as it is if fewer than four points remain."""
    def gap(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def thin(line):
        keep, stack = {0, len(line) - 1}, [(0, len(line) - 1)]
        while stack:
            i, j = stack.pop()
            if j - i > 1:
                m = max(range(i + 1, j), key=lambda k: gap(line[k], line[i], line[j]))
                if gap(line[m], line[i], line[j]) > tolerance:
                    keep.add(m)
                    stack += [(i, m), (m, j)]
        return [line[k] for k in sorted(keep)]

    if len(ring) < 4:
        return ring
    far = max(range(len(ring)), key=lambda k: math.dist(ring[0], ring[k]))
    out = thin(ring[: far + 1])[:-1] + thin(ring[far:])
    return out if len(out) >= 4 else ring
