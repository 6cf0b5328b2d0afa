"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits link at ``RADIUS`` = 4 or fewer differing bits. The bits are cut into
three blocks of 23, 23 and 18 bits (the last filled up with five zero bits), so two linked
fingerprints differ in at most one bit of some block. The anchors of a block are the 4096 words
of the perfect binary Golay code, whose balls of radius 3 cover all 23-bit words once. Each
fingerprint lies within 3 of one anchor, its home; a partner that differs there in at most one
bit lies within 3 + 1 of the same anchor. So a fingerprint goes to its three homes, a copy goes
to every anchor within 4 (five to six a block), and homes meet copies at each anchor: no link is
lost.

Equal fingerprints are merged first. An anchor's members are counted (3 x 4096 counts, a fixed
number) and dealt over so many tasks that each compares at most ``MEMBERS`` homes with
``MEMBERS`` copies; within a task, links are reduced to a spanning forest, so a large group of
near copies never gives all its pairs. The forests are joined by rounds of minimum labels.

Defined cases: a null or empty text has fingerprint zero; fewer than four words make one
shingle; repeated rows give repeated rows; null ids are never a group's smallest id unless all
are null. Other columns are ignored by the query and kept by ``near_dedup``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

SHINGLE = 4
RADIUS = 4
MEMBERS = 8192
SLICE = 512
#: First bit and width of each block, and the generator of the Golay code.
BLOCKS = ((0, 23), (23, 23), (46, 18))
GOLAY = 0b101011100011


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words) - SHINGLE + 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if n <= 1:
        return digest(join(words), 42)
    return majority(np.fromiter((digest(join(words[i : i + SHINGLE]), 42) for i in range(n)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The input's columns but for ``text``, and ``_cj_fp``, the fingerprint of every whole text as a long."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                fp = np.array([fingerprint(t or "") for t in part.column(0).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(fp)], [*(f.name for f in kept), "_cj_fp"])

    return docs.select("text", *(f.name for f in kept)).mapInArrow(run, f"{fields}, `_cj_fp` long")


def code_words() -> np.ndarray:
    """The 4096 words of the Golay code: all products with its generator over GF(2)."""
    words = np.zeros(1, np.uint32)
    for shift in range(12):
        words = np.concatenate([words, words ^ np.uint32(GOLAY << shift)])
    return words


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator."""
    rest = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> np.uint32(bit) & np.uint32(1), rest ^ np.uint32(GOLAY << (bit - 11)), rest)
    return rest


def flips(most: int) -> np.ndarray:
    """All 23-bit words of at most so many ones."""
    out, layer = [np.zeros(1, np.uint32)], [(0, -1)]
    for _ in range(most):
        layer = [(w | 1 << b, b) for w, last in layer for b in range(last + 1, 23)]
        out.append(np.array([w for w, _ in layer], np.uint32))
    return np.concatenate(out)


class Anchors:
    """For each remainder, the flips of at most 3 and of at most 4 bits that lead to an anchor."""

    def __init__(self) -> None:
        near, far = flips(3), flips(RADIUS)
        self.home = np.zeros(2048, np.uint32)
        self.home[syndrome(near)] = near
        of = syndrome(far)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=2048)
        self.many = np.full((2048, counts.max()), 1 << 30, np.uint32)  # 1 << 30: no flip
        at = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.many[of[order], at] = far[order]
        words = code_words()
        self.sorted = np.sort(words)

    def number(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.sorted, words)

    def members(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, anchor and whether at home, for each fingerprint and block."""
        rows, anchors, home = [], [], []
        own = np.arange(len(fp))
        for k, (start, width) in enumerate(BLOCKS):
            word = (fp >> np.uint64(start) & np.uint64((1 << width) - 1)).astype(np.uint32)
            rest = syndrome(word)
            rows.append(own)
            anchors.append(4096 * k + self.number(word ^ self.home[rest]))
            home.append(np.ones(len(fp), bool))
            flip = self.many[rest]
            there = flip < 1 << 30
            rows.append(np.repeat(own, there.sum(1)))
            anchors.append(4096 * k + self.number((word[:, None] ^ flip)[there]))
            home.append(np.zeros(int(there.sum()), bool))
        return np.concatenate(rows), np.concatenate(anchors), np.concatenate(home)


def placed(distinct: DataFrame) -> DataFrame:
    """fp, anchor, home: every place where a fingerprint takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Anchors()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 8192):
                part = fp[i : i + 8192]
                row, anchor, home = cover.members(part)
                yield pa.RecordBatch.from_arrays([pa.array(part[row].view(np.int64)), pa.array(anchor.astype(np.int32)), pa.array(home)], ["fp", "anchor", "home"])

    return distinct.select("fp").mapInArrow(run, "fp long, anchor int, home boolean")


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(homes: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and copies, as two arrays of fingerprints."""
    all_of, at = np.unique(np.concatenate([homes, copies]), return_inverse=True)
    h_at, c_at = at[: len(homes)], at[len(homes) :]
    label = np.arange(len(all_of))
    a, b = [], []
    step = max(1, (1 << 21) // max(1, len(copies)))
    for i in range(0, len(homes), step):
        apart = ones(homes[i : i + step, None] ^ copies[None, :])
        linked = (apart <= RADIUS) & (apart > 0)
        for r in np.flatnonzero(linked.any(1)):
            h, near = h_at[i + r], c_at[linked[r]]
            if (label[near] != label[h]).any():
                roots, first = np.unique(label[near], return_index=True)
                new = roots != label[h]
                a += [all_of[h]] * int(new.sum())
                b += all_of[near[first[new]]].tolist()
                merged = np.append(roots, label[h])
                label[np.isin(label, merged)] = merged.min()
    return np.array(a, np.uint64), np.array(b, np.uint64)


def links(distinct: DataFrame) -> DataFrame:
    """a, b: fingerprints whose links connect all that is connected (a spanning forest of each task)."""
    spark = distinct.sparkSession
    places = placed(distinct)
    counts = {(r["anchor"], r["home"]): r["n"] for r in places.groupBy("anchor", "home").agg(F.count("*").alias("n")).collect()}  # 24,576 rows at most
    # An anchor without homes or with a single fingerprint has nothing to compare.
    rows = [(k, math.ceil(counts[k, True] / MEMBERS), math.ceil(counts.get((k, False), 0) / MEMBERS)) for k in range(4096 * len(BLOCKS)) if (k, True) in counts and counts.get((k, False), 0) > 1]
    tasks = spark.createDataFrame(rows, "anchor int, homes int, copies int")
    dealt = places.join(F.broadcast(tasks), "anchor")  # at most 12,288 rows
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("copies"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("copies")).otherwise(F.col("homes")) - 1))
    dealt = dealt.select("fp", "anchor", "home", own.alias("own"), others.alias("other"))
    dealt = dealt.select("fp", "home", "anchor", F.when(F.col("home"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("home"), F.col("other")).otherwise(F.col("own")).alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        fp, home = group.column("fp").to_numpy().view(np.uint64), group.column("home").to_numpy()
        a, b = forest(fp[home], fp[~home])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("anchor", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (a member of the component) for every node of ``edges``.

    Each round gives a node the least label around it and then that label's own label. Labels
    only fall, and rounds stop when none does.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "simhash-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "simhash-labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("least"))
        near = labels.join(around, labels["node"] == around["a"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("least", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = near.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root"))
        after = stored(after, "simhash-labels")
        labels = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return labels


def classes(prints: DataFrame) -> DataFrame:
    """fp, component_id, root of every distinct fingerprint, from doc_id, _cj_fp."""
    distinct = stored(prints.groupBy(F.col("_cj_fp").alias("fp")).agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = components(links(distinct))
    joined = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every document."""
    prints = stored(fingerprints(docs.select("doc_id", "text")), "simhash-prints")
    d = prints.join(classes(prints), prints["_cj_fp"] == F.col("fp"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("_cj_fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The first row of each ``root``, with all columns of ``docs``, from doc_id, ka, kb, root of every row."""
    columns = docs.columns
    text = text_of("text")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "ka", "kb"))
    kept = stored(grouped.groupBy("root").agg(best.alias("k")).select("k.ka", "k.kb"), "simhash-kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_cj_row"), F.xxhash64("doc_id", text).alias("ka"), F.xxhash64(text, "doc_id", F.lit(7)).alias("kb"))
    first = rows.join(kept.hint("shuffle_hash"), ["ka", "kb"])
    once = Window.partitionBy("ka", "kb").orderBy(F.lit(1))
    first = first.withColumn("_cj_n", F.row_number().over(once)).where("_cj_n = 1")
    return first.select(*[F.col(f"_cj_row.`{c}`").alias(c) for c in columns])


def near_dedup(docs: DataFrame, by_similarity: bool = False) -> DataFrame:
    """One document of each component, with all its columns: the one of smallest id, and of rows that share that id one by text.

    Documents link by their fingerprints, or ``by_similarity`` of their five-word shingles at 0.8 or
    more: see ``near_copies``, which checks links exactly and completes what fingerprints find. Texts are fingerprinted, then only ids and fingerprints move; kept rows are found by an id's
    and text's hash. Rows equal in id and text count as one.
    """
    if by_similarity:
        from . import near_copies

        return near_copies.near_dedup(docs)
    text = text_of("text")
    keyed = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("doc_id", text).alias("ka"), F.xxhash64(text, "doc_id", F.lit(7)).alias("kb"))
    prints = stored(fingerprints(keyed), "simhash-prints")
    d = prints.join(classes(prints), prints["_cj_fp"] == F.col("fp"))
    return first_of_each(docs, d)
