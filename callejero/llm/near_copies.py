"""SimHash near-dedup with links by similarity: what ``simhash.near_dedup`` does where it is given a least similarity.

Two documents link where the Jaccard similarity of their sets of ``SHINGLE``-word shingles
(lower-cased in A-Z, hashed to 64 bits) is at least ``SIMILAR``; linked documents form components.
Every link is checked exactly on the two whole sets. Equal sets are merged first. Then candidates
come in three steps, and sets already in one component are never compared again:

1. SimHash: fingerprints over the same shingles that differ in at most four bits, found at
   anchor points as in ``simhash``. This joins what differs in a few words. It cannot find the
   rest: at similarity 0.8 fingerprints of 64 bits differ in some ten.
2. Buckets of ``ROWS`` min-hashes, ``BANDS`` a set: two sets of similarity s share none with
   probability (1 - s ** 3) ** 20, 6e-7 at 0.8 and less above. Buckets are counted before they meet
   and dealt over blocks of at most ``MEMBERS`` sets on average. Within the first ``EARLY`` bands, each
   block compares its own members and the bucket's smallest one, which joins large groups at a
   cost that grows in proportion.
3. Buckets of all bands whose members are not yet in one component compare all pairs of their blocks.

Defined cases: fewer than five words make one shingle, so empty and null texts are alike; null ids
are never a group's smallest id unless all are null; rows equal in id and text count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .simhash import components, first_of_each, links, majority

SHINGLE = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS, EARLY = 20, 3, 2
MEMBERS = 128
SLICE = 512
#: Words whose hashes a worker remembers.
HELD = 200_000

_RNG = np.random.default_rng(11)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
PLACES = _RNG.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    """Hash of a word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 5)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, hash_of: Words) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 6)], np.uint64)
    w = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total = mixed(total + w[k : k + n] * PLACES[k])
    return np.unique(total)


def buckets(shingles: np.ndarray) -> np.ndarray:
    """One bucket a band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * FACTORS + SHIFTS).min(0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * PLACES[k] + least[k::ROWS])
    return out


def prints_of(keyed: DataFrame) -> DataFrame:
    """doc_id, ka, kb, sid (hash of the whole set), fp (its fingerprint) and buckets of every row of doc_id, ka, kb, text."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = Words()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                sets = [shingle_set(t or "", hash_of) for t in part.column(3).to_pylist()]
                sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
                places = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([buckets(s) for s in sets]).view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
                fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sid), pa.array(fp), places], ["doc_id", "ka", "kb", "sid", "fp", "buckets"])

    return keyed.select("doc_id", "ka", "kb", "text").mapInArrow(run, f"doc_id {kind}, ka long, kb long, sid long, fp long, buckets array<long>")


def sets_of(texts: DataFrame) -> DataFrame:
    """sid, shingles (binary) from sid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = Words()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t or "", hash_of).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["sid", "shingles"])

    return texts.select("sid", "text").mapInArrow(run, "sid long, shingles binary")


def similar(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of different labels that join all which links join."""
    up, down = SIMILAR
    sizes = np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    label, out = label.copy(), []
    for i in range(len(sets) - 1):
        apart = label != label[i]
        if not apart.any():
            if (label == label[0]).all():
                break
            continue
        apart[: i + 1] = False
        own = np.zeros(len(at), bool)
        own[at[starts[i] : ends[i]]] = True
        both = np.add.reduceat(own[at], starts, dtype=np.int64)
        for j in np.flatnonzero(apart & (down * both >= up * (sizes[i] + sizes - both))):
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def compared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links within each (bucket, i, j) of members, which have sid and root."""

    def run(group: pa.Table) -> pa.Table:
        sid = group.column("sid").to_numpy()
        root = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]
        found = similar([np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()], root)
        return pa.table({"a": pa.array([int(sid[i]) for i, _ in found], pa.int64()), "b": pa.array([int(sid[j]) for _, j in found], pa.int64())})

    d = members.select("bucket", "i", "j", "sid", "root").join(sets, "sid")
    return d.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def by_fingerprint(distinct: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: similar sets whose fingerprints are equal or meet at an anchor, one link each."""
    prints = stored(distinct.groupBy("fp").agg(F.min("sid").alias("rep")), "near-fingerprints")
    end = lambda name: prints.select(F.col("fp").alias(name), F.col("rep").alias(f"{name}_rep"))
    apart = links(prints).join(end("a"), "a").join(end("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    alike = distinct.select("sid", "fp").join(prints, "fp").where("sid <> rep").select(F.col("sid").alias("a"), F.col("rep").alias("b"))
    held = lambda name: sets.select(F.col("sid").alias(name), F.col("shingles").alias(f"{name}_set"))
    pairs = apart.unionByName(alike).join(held("a"), "a").join(held("b"), "b").select("a", "b", "a_set", "b_set")
    up, down = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(down * both >= up * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def roots(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """node, root of all sets that have links, from distinct (sid, ka, kb, fp, buckets) and docs (ka, kb, text)."""
    places = distinct.select("sid", F.posexplode("buckets").alias("band", "bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("n"), F.min("sid").alias("hub")).where("n > 1")
    places = stored(places.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / MEMBERS).cast("int")), "near-places")
    needed = distinct.select("sid", "ka", "kb").join(places.select("sid").distinct(), "sid")
    texts = docs.select("ka", "kb", "text").join(needed.hint("shuffle_hash"), ["ka", "kb"])
    sets = stored(sets_of(texts).dropDuplicates(["sid"]), "near-sets")

    block = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def rooted(members: DataFrame, found: DataFrame) -> DataFrame:
        """``members`` with their root so far, of the buckets whose members are not all in one component."""
        d = members.join(components(found), F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid")).drop("node")
        apart = d.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("apart")).where("apart").select("bucket")
        return stored(d.join(apart, "bucket"), "near-apart")

    found = stored(by_fingerprint(distinct, sets), "near-links")
    early = rooted(places.where(F.col("band") < EARLY), found)
    hubs = early.where("sid = hub").select("bucket", "sid", "root", every.alias("i"))
    early = early.select("bucket", "sid", "root", block.alias("i")).unionByName(hubs).distinct()
    found = stored(found.unionByName(compared(early.withColumn("j", F.col("i")), sets)), "near-links")

    late = rooted(places, found).select("bucket", "sid", "root", block.alias("own"), every.alias("other"))
    late = late.select("bucket", "sid", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return components(found.unionByName(stored(compared(late, sets), "near-links")))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one of smallest id, and of rows that share that id one by text."""
    text = text_of("text")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", text).alias("ka"), F.xxhash64(text, "doc_id", F.lit(7)).alias("kb"))
    prints = stored(prints_of(keyed), "near-prints")
    one = prints.groupBy("sid").agg(F.min(F.struct("ka", "kb", "fp", "buckets")).alias("k"))
    distinct = stored(one.select("sid", "k.ka", "k.kb", "k.fp", "k.buckets"), "near-distinct")
    labels = roots(distinct, keyed)
    grouped = prints.select("doc_id", "ka", "kb", "sid").join(labels, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid"))
    return first_of_each(docs, grouped)
