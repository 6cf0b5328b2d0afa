"""Line dedup over a suffix array of line ids, built by distributed prefix doubling.

A document is a sequence of line ids. A run of lines that has at least ``min_words`` words and
occurred earlier (by document id, then position) is a later copy, and its lines are deleted.

1. Lines that occur once cannot be in a repeated run. Counting drops them and cuts each
   document into segments of repeated lines.
2. The other lines are ranked: the rank of a suffix is the number of suffixes that sort before
   it. Ranks to depth 1 come from the counts; ranks to depth 2d from pairs of ranks to depth d
   at distance d. Suffixes of equal rank share a prefix of that depth: they form an interval of
   the longest-common-prefix table.
3. A maximal repeated run is the union of the smallest windows in it that reach ``min_words``
   from a first or up to a last line. Two windows of n lines are equal where the ranks to depth
   2^k <= n agree at their start and at 2^k lines before their end. So the doubling ends at the
   longest such window, not at the longest copy.
4. In every interval the earliest window stays; the lines of all others go.

Counts are combined before each shuffle; a line that a third of all rows share meets only in
joins whose partitions Spark can split, and the windows of the most frequent runs are salted. Main path: DataFrame
functions only.

Defined cases: a null text stays null and has no lines; an empty text has one empty line. Rows
equal in id and text are one document: they lose the same lines. Null ids sort last. A text
that loses all lines becomes empty. Other columns pass through, ``n_chars`` follows the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

MIN_WORDS = 50
#: Ranks are summed within ranges of this many parts, then over the parts.
PARTS = 4096
#: The most frequent runs (a number fixed for each doubling, broadcast) and over how many tasks each is dealt.
HOT, SALTS = 1024, 64


def document_keys(ident: Column, text: Column) -> list[Column]:
    """128 bits for id and text together, neither null."""
    return [F.xxhash64(ident, text).alias("ka"), F.xxhash64(text, ident, F.lit(7)).alias("kb")]


def line_table(docs: DataFrame) -> DataFrame:
    """One row per document: ka, kb, doc_id, lines as (a, b, w): 128 bits of the line, its words."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(7)).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("w")),
    )
    d = docs.where(F.col("text").isNotNull()).select(*document_keys(F.col("doc_id"), F.col("text")), "doc_id", lines.alias("lines"))
    return d.groupBy("ka", "kb").agg(F.first("doc_id").alias("doc_id"), F.first("lines").alias("lines"))


def rank_within(df: DataFrame, group: list[str], part: Column, order: list[str], size: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of ``group`` that sort before.

    ``part`` rises with ``order``, so no window holds more than a part of a group, or PARTS rows.
    """
    df = df.withColumn("_part", part)
    inner = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*group, "_part").agg(F.sum(size).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
    df = df.withColumn("_inner", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return df.join(parts.drop("_sum"), [*group, "_part"]).withColumn(out, F.col("_before") + F.col("_inner")).drop("_part", "_before", "_inner")


def repeated_positions(lines: DataFrame) -> DataFrame:
    """ka, kb, doc_id, seg, pos, w, rank of every line that occurs more than once; seg numbers unbroken stretches."""
    each = lines.select("ka", "kb", "doc_id", F.posexplode("lines").alias("pos", "l")).select("ka", "kb", "doc_id", "pos", "l.a", "l.b", "l.w")
    often = each.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    often = stored(often, "lines-repeated")
    ranked = rank_within(often, [], F.shiftrightunsigned("a", 52).cast("int"), ["a", "b"], "n", "rank").drop("n")
    found = each.join(ranked, ["a", "b"]).drop("a", "b")
    along = Window.partitionBy("ka", "kb").orderBy("pos")
    return found.withColumn("seg", F.col("pos") - F.row_number().over(along))


def smallest_windows(found: DataFrame, min_words: int) -> DataFrame:
    """ka, kb, doc_id, s, e: from each line the shortest window of enough words, and up to each line."""
    seg = Window.partitionBy("ka", "kb", "seg")
    d = found.withColumn("upto", F.sum("w").over(seg.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    point = lambda v, kind: F.struct(v.alias("v"), F.lit(kind).alias("line"))
    seen = lambda w: F.last(F.when(F.col("p.line") == 1, F.col("pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = d.select("ka", "kb", "doc_id", "seg", "pos", F.explode(F.array(point(F.col("upto"), 1), point(F.col("upto") - F.col("w") + min_words, 0))).alias("p"))
    ahead = ahead.withColumn("e", seen(seg.orderBy(F.desc("p.v"), F.desc("p.line"), F.desc("pos")))).where("p.line = 0 AND e IS NOT NULL")
    back = d.select("ka", "kb", "doc_id", "seg", "pos", F.explode(F.array(point(F.col("upto") - F.col("w"), 1), point(F.col("upto") - min_words, 0))).alias("p"))
    back = back.withColumn("s", seen(seg.orderBy("p.v", F.desc("p.line"), "pos"))).where("p.line = 0 AND s IS NOT NULL")
    both = ahead.select("ka", "kb", "doc_id", F.col("pos").alias("s"), "e").unionByName(back.select("ka", "kb", "doc_id", "s", F.col("pos").alias("e")))
    return both.withColumn("n", F.col("e") - F.col("s") + 1).withColumn("k", F.floor(F.log2("n")).cast("int"))


def doubled(ranks: DataFrame, depth: int) -> DataFrame:
    """Ranks to twice the depth, of the positions whose segment goes on that far."""
    along = Window.partitionBy("ka", "kb", "seg").orderBy("pos")
    pairs = ranks.withColumn("next", F.lead("rank", depth).over(along)).where("next IS NOT NULL")
    counts = stored(pairs.groupBy("rank", "next").agg(F.count("*").alias("n")), "lines-pairs")
    # next is below the number of lines: its upper bits cut a group into parts that rise with it
    top = counts.agg(F.max("next")).first()[0] or 0
    part = F.floor(F.col("next") * F.lit(PARTS) / F.lit(top + 1)).cast("int")
    again = rank_within(counts, ["rank"], part, ["next"], "n", "offset").select("rank", "next", (F.col("rank") + F.col("offset")).alias("deeper"))
    return pairs.join(again, ["rank", "next"]).select("ka", "kb", "seg", "pos", F.col("deeper").alias("rank"))


def later_copies(windows: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """ka, kb, s, e of the windows of 2^k to 2^(k+1) - 1 lines that occurred earlier."""
    at = lambda name, out: ranks.select("ka", "kb", F.col("pos").alias(name), F.col("rank").alias(out))
    w = windows.where(F.col("k") == k).join(at("s", "ra"), ["ka", "kb", "s"])
    if k:
        w = w.withColumn("tail", F.col("e") - (1 << k) + 1).join(at("tail", "rb"), ["ka", "kb", "tail"])
    else:
        w = w.withColumn("rb", F.col("ra"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ka", "kb", "s")
    w = w.select("ka", "kb", "s", "e", "n", "ra", "rb", place.alias("place"))
    run = ["n", "ra", "rb"]
    first = w.groupBy(*run).agg(F.min("place").alias("first"), F.max("place").alias("final"), F.count("*").alias("copies")).where("final > first").drop("final")
    # Windows of the most frequent runs are dealt over SALTS tasks each, whose first place goes to all of these.
    hot = F.broadcast(first.orderBy(F.desc("copies"), *run).limit(HOT).select(*run, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("ka", "kb", "s"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    dealt = w.join(hot, run, "left").withColumn("salt", salt).drop("hot")
    spread = first.join(hot, run, "left").select(*run, "first", salts.alias("salt"))
    return dealt.join(spread, [*run, "salt"]).where("place > first").select("ka", "kb", "s", "e")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """ka, kb, gone: the positions (from 0) of the lines that each changed document loses, sorted."""
    lines = stored(line_table(docs), "lines")
    found = stored(repeated_positions(lines), "lines-found")
    windows = stored(smallest_windows(found, max(1, min_words)), "lines-windows")
    deepest = windows.agg(F.max("k")).first()[0]
    ranks, copies = found.select("ka", "kb", "seg", "pos", "rank"), []
    for k in range((deepest or 0) + 1):
        copies.append(stored(later_copies(windows, ranks, k), "lines-copies"))
        if k < (deepest or 0):
            ranks = stored(doubled(ranks, 1 << k), "lines-ranks")
    spans = reduce(DataFrame.unionByName, copies)
    # Spans of a document overlap; joined ends keep what is gathered near the document's own lines.
    along = Window.partitionBy("ka", "kb").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.distinct().withColumn("s", F.greatest("s", F.coalesce(F.max("e").over(along) + 1, F.lit(0)))).where("s <= e")
    return spans.groupBy("ka", "kb").agg(F.sort_array(F.flatten(F.collect_list(F.sequence("s", "e")))).alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, tally: bool = False) -> DataFrame:
    """The documents without later copies of repeated line runs; ``tally`` adds n_lines and n_removed."""
    columns = docs.columns
    gone = stored(deleted_lines(docs, min_words), "lines-gone")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_cj_row"), F.col("text").alias("_cj_text"), *document_keys(F.col("doc_id"), F.col("text")))
    d = d.join(gone.hint("shuffle_hash"), ["ka", "kb"], "left")
    d = d.withColumn("_cj_lines", F.split("_cj_text", "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_cj_lines") - 1), F.col("gone")), lambda i: F.col("_cj_lines")[i])
    d = d.withColumn("_cj_new", F.when(F.col("gone").isNull(), F.col("_cj_text")).otherwise(F.array_join(left, "\n")))
    changed = {"text": F.col("_cj_new")}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(F.col("gone").isNull(), F.col("_cj_row.n_chars")).otherwise(F.length("_cj_new").cast(docs.schema["n_chars"].dataType))
    out = [changed.get(c, F.col(f"_cj_row.`{c}`")).alias(c) for c in columns]
    if tally:
        out += [F.coalesce(F.size("_cj_lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")]
    return d.select(*out)
