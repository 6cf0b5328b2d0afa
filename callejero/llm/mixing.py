"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of all words by its weight, at most ``cap`` times its own size; what
a capped source cannot use is shared out again by weight. A source's target is met by whole
epochs first. For the rest, documents get exponential keys ``-ln(u) / quality``; they are
sorted by key within their source and taken as long as the prefix sum of their sizes stays
within the budget (the document at the boundary goes in where at least half of it fits).

No source is ever sorted as a whole: keys are cut into ranges, range sums give the one range
of each source where the budget ends, which is cut again until it holds ``WINDOW`` rows at most,
and only these are sorted. Selection is then a
comparison with the source's cut, so texts never move. Main path: DataFrame functions only.

Defined cases: null or empty texts have size 0 and are never taken; a null source is a source
of its own, last; rows equal in id and text share one key and are taken or left together;
``u`` comes from a digest of id and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of, word_count

RANGES = 1024
#: Rows of a source that are sorted in one window at most, unless they share one key.
WINDOW = 50_000
#: Tables of one row per source are broadcast up to so many sources; beyond that Spark deals the joins.
BROADCAST_SOURCES = 50_000
CYCLE = (1, 2, 3)
CAP = 3


def quality_weight(text: Column, size: Column) -> Column:
    """In (0, 1]: falls as symbols per word rise."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return 1.0 / (1.0 + symbols / F.greatest(size, F.lit(1)))


def sampling_key(ident: Column, text: Column, quality: Column) -> Column:
    digest = F.md5(F.encode(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit("|"), F.md5(F.encode(text, "UTF-8"))), "UTF-8"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.ln(u) / quality


def key_range(key: Column, ranges: int = RANGES) -> Column:
    """A number of the key's range that rises with the key; even for a quality of 1."""
    return F.least(F.lit(ranges - 1), F.floor(ranges * (1.0 - F.exp(-key)))).cast("int")


def sized(docs: DataFrame, ident: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, key and range of every document: all that planning reads."""
    text = text_of(text_col)
    d = docs.select(F.col(ident).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), text.alias("_t"))
    d = d.select("doc_id", "source", "size", sampling_key(F.col("doc_id"), F.col("_t"), quality_weight(F.col("_t"), F.col("size"))).alias("key"))
    return d.withColumn("range", key_range(F.col("key")))


def targets(sums: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target from one row (source, source_size) per source.

    Sources fill like vessels under one level: sorted by the level at which each is full, the
    first that the remaining words do not fill sets the level of all after it. The windows
    hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, cycle))
    s = sums.select("source", "source_size", F.element_at(weights, (F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("long").alias("weight"))
    s = s.withColumn("limit", F.col("source_size") * cap).withColumn("full_at", F.col("limit") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    s = s.withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left") / F.col("open_weight"))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    target = F.when(F.col("full_at") < F.col("level"), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mixing_plan(base: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """One row per source: source_size, target, epochs, and the cut of the fractional rest.

    ``base`` is a stored ``sized`` table; it is read three times.
    """
    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sums = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    t = targets(sums, cycle, cap)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    t = t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    t = stored(t, "mixing-targets")
    small = F.broadcast if t.count() <= BROADCAST_SOURCES else lambda df: df
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    r = ranges.withColumn("through", F.sum("range_size").over(along)).alias("r").join(small(t).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    ends = r.where(F.col("through") > F.col("rest")).groupBy("t.source").agg(F.min("range").alias("cut_range"), F.min_by(F.col("rest") - (F.col("through") - F.col("range_size")), F.col("range")).alias("budget"))
    ends = ends.withColumnRenamed("source", "cut_source")
    inside = base.join(small(ends), base["source"].eqNullSafe(F.col("cut_source")) & (base["range"] == F.col("cut_range"))).select("cut_source", "budget", F.lit(None).cast("double").alias("below"), "key", "size")
    while True:
        # Low weights crowd the last range: it is cut again, between its own least and largest key, until it is small.
        spans = inside.groupBy("cut_source", "budget").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        wide = stored(spans.where((F.col("n") > WINDOW) & (F.col("lo") < F.col("hi"))), "mixing-wide")
        if wide.isEmpty():
            break
        inside = stored(narrowed(inside, small(wide)), "mixing-inside")
    ties = inside.groupBy("cut_source", "budget", "below", "key").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("cut_source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ties = ties.withColumn("middle", F.sum("size").over(order) - F.col("size") / 2)
    cuts = ties.groupBy("cut_source").agg(F.coalesce(F.max(F.when(F.col("middle") <= F.col("budget"), F.col("key"))), F.max("below")).alias("cut_key"))
    ends = ends.alias("e").join(cuts.alias("c"), F.col("e.cut_source").eqNullSafe(F.col("c.cut_source")), "left").select("e.cut_source", "cut_range", "cut_key")
    full = t.join(ends, t["source"].eqNullSafe(ends["cut_source"]), "left")
    return small(full.select("source", "source_size", "target", "epochs", "cut_range", "cut_key"))


def narrowed(inside: DataFrame, wide: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``inside`` (cut_source, budget, below, key, size) where the sources of ``wide`` (cut_source, lo, hi) keep one of so many even parts of their keys: that in which the budget ends.

    ``below`` is the largest key of the parts before, which are all within the budget.
    """
    w = wide.select(F.col("cut_source").alias("w_source"), "lo", "hi")
    d = inside.join(w, F.col("cut_source").eqNullSafe(F.col("w_source")), "left")
    part = F.when(F.col("lo").isNull(), -1).otherwise(F.least(F.lit(ranges - 1), F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * ranges))).cast("int")
    d = d.select("cut_source", "budget", "below", "key", "size", part.alias("part"))
    # At most so many rows a source.
    sums = d.where("part >= 0").groupBy("cut_source", "budget", "part").agg(F.sum("size").alias("part_size"), F.max("key").alias("top"))
    along = Window.partitionBy("cut_source").orderBy("part")
    sums = sums.withColumn("through", F.sum("part_size").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("under", F.max("top").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    left = F.col("budget") - (F.col("through") - F.col("part_size"))
    # The range was chosen because the words through it pass the budget, so the words through one of its parts do.
    ends = sums.where(F.col("through") > F.col("budget")).groupBy("cut_source").agg(F.min_by(F.struct("part", left.alias("left"), "under"), "part").alias("e"))
    ends = stored(ends.select(F.col("cut_source").alias("e_source"), "e"), "mixing-parts")
    small = F.broadcast(ends) if ends.count() <= BROADCAST_SOURCES else ends
    j = d.join(small, F.col("cut_source").eqNullSafe(F.col("e_source")), "left").where((F.col("part") < 0) | (F.col("part") == F.col("e.part")))
    return j.select("cut_source", F.coalesce("e.left", "budget").alias("budget"), F.coalesce("e.under", "below").alias("below"), "key", "size")


def copies(key: Column, rng: Column) -> Column:
    """How often the mix takes a document, from its source's row of the plan."""
    chosen = (rng < F.col("cut_range")) | ((rng == F.col("cut_range")) & (key <= F.col("cut_key")))
    return F.col("epochs") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)


def mixture(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source of every document."""
    base = stored(sized(docs), "mixing-sizes")
    plan = mixing_plan(base, cycle, cap).withColumnRenamed("source", "plan_source")
    d = base.join(plan, base["source"].eqNullSafe(plan["plan_source"]))
    d = d.withColumn("copies", F.when(F.col("size") > 0, copies(F.col("key"), F.col("range"))).otherwise(0))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with all its columns."""
    base = stored(sized(docs), "mixing-sizes")
    plan = mixing_plan(base, cycle, cap).withColumnRenamed("source", "_cj_source")
    columns = docs.columns
    text = text_of("text")
    size = word_count(text)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_cj_row"), F.col("source").alias("_cj_own"), size.alias("_cj_size"), sampling_key(F.col("doc_id"), text, quality_weight(text, size)).alias("_cj_key"))
    d = d.join(plan, F.col("_cj_own").eqNullSafe(F.col("_cj_source")))
    times = F.when(F.col("_cj_size") > 0, copies(F.col("_cj_key"), key_range(F.col("_cj_key")))).otherwise(0)
    d = d.withColumn("_cj_times", times).where(F.col("_cj_times") > 0)
    d = d.select("_cj_row", F.explode(F.sequence(F.lit(1), F.col("_cj_times"))).alias("_cj_copy"))
    return d.select(*[F.col(f"_cj_row.`{c}`").alias(c) for c in columns])
