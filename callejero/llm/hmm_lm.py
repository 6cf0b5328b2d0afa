"""Language-model scoring with a hidden Markov model.

A text is its words, lower-cased in A-Z, and one end token. The model gives it the probability

    sum over state sequences of start * moves * product of P(token | state)

Baum-Welch trains it in two steps, each over all training documents; every task adds up its expected
counts, and the sums over partitions give the next parameters.

1. While the states are found, emissions are tied: the ``OWN`` most frequent training tokens and the
   end have classes of their own, all others share ``HASHED`` classes by crc32, and a token's
   probability is its class's times its share of the class. The first guess comes from the counts
   of neighbouring classes in the whole training part, split into as many components as there are
   states. Passes end when one raises the likelihood of the training documents by less than ``GAIN``
   (log10 a token).
2. The last pass is repeated with emission counts by (token, state) for every training token, a
   distributed table that grows with the vocabulary. A token's count is smoothed by its tied
   probability, with the weight of one occurrence a distinct token.

Scoring runs the scaled forward recursion over every whole text, so its logarithm is the exact
likelihood. Long texts are cut into blocks that run side by side: the product of a block's step
matrices, one row a state, tells how it leads from the state before it to its last one, so blocks
are chained exactly.

Token counts cover all training documents and are summed before the shuffle. The ``KNOWN`` most
frequent tokens (a fixed number) are broadcast with their counts by state; the rest of a document's
tokens, a small part of all, is joined with the table. Tasks work on ``HELD_TOKENS`` tokens at a
time, however these are spread over documents (a longer document is held alone).

Defined cases: a null or empty text is its end token alone; a null id counts as the empty text for
the fold; repeated rows give repeated rows; without training tokens all counts are zero and all
classes equally likely. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_residue, stored

FOLDS, HELD_OUT = 5, 1
OWN, HASHED = 1500, 256
#: Tokens with numbers of their own, the end included; the last 16-bit number marks all others.
KNOWN = 65_535
STATES = 6
#: The least gain of a pass, log10 likelihood a token.
GAIN = 0.001
#: Distinct tokens that a task holds before it passes their counts on, documents encoded and tokens worked on at a time.
HOLD, SLICE, HELD_TOKENS = 100_000, 256, 250_000
#: Steps of a block.
LENGTH = 256
#: Classes whose place as right neighbour the first guess tells apart, its starts and rounds.
RIGHT, STARTS, ROUNDS = 256, 4, 150
#: Expected counts by token are whole multiples of 1 / PARTS, so their sums are the same in any order.
PARTS = 4096
END = b""
CLASSES = 1 + OWN + HASHED


def tokens_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def token_counts(train: DataFrame) -> DataFrame:
    """token (binary), c: counts over all training texts; the empty token is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])
            held.clear()
            return batch

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(tokens_of(t))
                if len(held) > HOLD:
                    yield out()
        yield out()

    return train.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list:
    """Rows (token, c) of the most frequent tokens, at most so many: those above a count that a histogram gives.

    The histogram has sixteen bins per doubling, so the driver gets some hundred bins and then the tokens alone.
    """
    bin_of = F.floor(F.log2("c") * 16).cast("int")
    left, least = most, None
    for r in sorted(counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["bin"]):
        if r["n"] > left:
            break
        left, least = left - r["n"], r["bin"]
    if least is None:
        return []
    return sorted(counts.where(bin_of >= least).collect(), key=lambda r: (-r["c"], bytes(r["token"])))


def hashed_class(token: str = "token"):
    return (1 + OWN + F.crc32(F.col(token)) % HASHED).cast("int")


class Model:
    """start, move (states x states) and emit (classes x states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(states: int, base: np.ndarray, pairs: np.ndarray, seed: int = 7) -> Model:
        """From counts of (class, right neighbour's class): the most likely of some splits into components."""
        total, best = max(pairs.sum(), 1.0), None
        for start in range(STARTS):
            rng = np.random.default_rng(seed + start)
            size = np.full(states, 1 / states)
            left = rng.uniform(0.5, 1.5, (len(base), states)) * base[:, None]
            right = rng.uniform(0.5, 1.5, (states, pairs.shape[1])) * (pairs.sum(0) / total + 1e-9)
            left, right = left / left.sum(0), right / right.sum(1, keepdims=True)
            for _ in range(ROUNDS):
                ratio = pairs / np.maximum((left * size) @ right, 1e-300)
                new_left, new_right = left * size * (ratio @ right.T) + 1e-12 * base[:, None], right * size[:, None] * (left.T @ ratio) + 1e-300
                size = new_left.sum(0)
                left, right = new_left / size, new_right / new_right.sum(1, keepdims=True)
                size = size / size.sum()
            likelihood = float((pairs * np.log(np.maximum((left * size) @ right, 1e-300))).sum())
            if best is None or likelihood > best[0]:
                best = (likelihood, size, left)
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9)
        emit = 0.98 * best[2] + 0.02 * base[:, None]
        return Model(best[1], move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def of_counts(counts: np.ndarray, base: np.ndarray, states: int) -> Model:
        """From expected counts, flat: start, moves, emissions. Smoothing keeps all positive."""
        s, m, e = np.split(counts, [states, states + states * states])
        start = s + 1.0
        move = m.reshape(states, states) + 1.0
        emit = e.reshape(-1, states) + 20.0 * base[:, None]
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Rows:
    """Stretches of a flat array side by side, by falling length: step t of row r has place start[t] + r."""

    def __init__(self, at: np.ndarray, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        at, lengths = at[self.order], lengths[self.order]
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        self.start = np.concatenate([[0], np.cumsum(self.active)])
        row = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = self.start[step] + row
        self.token, self.row = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        self.token[place] = at[row] + step
        self.row[place] = row


class Packed:
    """Sequences of symbols, end to end in ``flat`` and cut into blocks of at most LENGTH steps."""

    def __init__(self, sequences: list[np.ndarray] | np.ndarray, lengths: np.ndarray | None = None) -> None:
        if lengths is None:
            lengths = np.array([len(s) for s in sequences], np.int64)
            sequences = np.concatenate(sequences)
        self.flat = sequences.astype(np.int64, copy=False)
        self.order = np.arange(len(lengths))
        blocks = -(-lengths // LENGTH)
        self.sequence = np.repeat(self.order, blocks)
        self.nth = np.arange(len(self.sequence)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        self.size = np.minimum(LENGTH, lengths[self.sequence] - self.nth * LENGTH)
        self.at = (np.cumsum(lengths) - lengths)[self.sequence] + self.nth * LENGTH
        self.heads = np.flatnonzero((self.nth == 0) & (blocks[self.sequence] > 1))
        self.later = np.flatnonzero(self.nth > 0)
        self.rows = Rows(self.at, self.size)


def steps(move: np.ndarray, emit: np.ndarray, rows: Rows, begin: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Scales by place, scaled forward values by place if ``keep``, and each row's last ones; states come first."""
    back = np.ascontiguousarray(move.T)
    scale = np.empty(emit.shape[1])
    alphas = np.empty_like(emit) if keep else None
    ends, alpha, last = np.empty_like(begin), begin, begin.shape[1]
    for t, n in enumerate(rows.active):
        a = rows.start[t]
        if n < last:
            ends[:, n:last] = alpha[:, n:]
        now = (back @ alpha[:, :n] if t else begin) * emit[:, a : a + n]
        now.sum(0, out=scale[a : a + n])
        now /= scale[a : a + n]
        if keep:
            alphas[:, a : a + n] = now
        alpha, last = now, n
    ends[:, :last] = alpha
    return scale, alphas, ends


def joints(model: Model, table: np.ndarray, packed: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By block: state distribution before its first emission, forward values of its last step, backward values of that step."""
    states = len(model.start)
    begin = np.repeat(model.start[:, None], len(packed.nth), 1)
    last, end = np.empty_like(begin), np.ones_like(begin)
    if not len(packed.later):
        return begin, last, end
    heads, later = packed.heads, packed.later
    rows = Rows(packed.at[heads], packed.size[heads])
    last[:, heads[rows.order]] = steps(model.move, table[:, packed.flat[rows.token]], rows, begin[:, heads], False)[2]
    # A block's matrix, up to a factor: its step matrices multiplied from the left, one row a state before it.
    through, back = np.empty((len(packed.nth), states, states)), np.ascontiguousarray(model.move.T)
    rows = Rows(packed.at[later], packed.size[later])
    emit = table[:, packed.flat[rows.token]]
    product, last_n = np.repeat(back.T[:, :, None], len(later), 2), len(later)
    of = later[rows.order]
    for t, n in enumerate(rows.active):
        if n < last_n:
            through[of[n:last_n]] = product[:, :, n:].transpose(2, 0, 1)
        product, last_n = (np.matmul(back, product[:, :, :n]) if t else product) * emit[:, rows.start[t] : rows.start[t] + n], n
        product /= product.sum((0, 1))
    through[of[:last_n]] = product.transpose(2, 0, 1)
    for k in range(1, packed.nth.max() + 1):
        b = np.flatnonzero(packed.nth == k)
        begin[:, b] = model.move.T @ last[:, b - 1]
        reached = np.einsum("ib,bij->jb", last[:, b - 1], through[b])
        last[:, b] = reached / reached.sum(0)
    for k in range(packed.nth.max(), 0, -1):
        b = np.flatnonzero(packed.nth == k)
        ahead = np.einsum("bij,jb->ib", through[b], end[:, b])
        end[:, b - 1] = ahead / (ahead * last[:, b - 1]).sum(0)
    return begin, last, end


def likelihoods(packed: Packed, scale: np.ndarray) -> np.ndarray:
    by_block = np.bincount(packed.rows.row, np.log10(scale), len(packed.nth))
    return np.bincount(packed.sequence[packed.rows.order], by_block, len(packed.order))


def forward(model: Model, packed: Packed, keep: bool, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """log10 likelihood by sequence; scales by place; scaled forward values if ``keep``. ``table``: states x symbols, else the model's emissions."""
    table = np.ascontiguousarray(model.emit.T) if table is None else table
    rows = packed.rows
    begin = joints(model, table, packed)[0]
    scale, alphas, _ = steps(model.move, table[:, packed.flat[rows.token]], rows, begin[:, rows.order], keep)
    return likelihoods(packed, scale), scale, alphas


def posterior(model: Model, packed: Packed, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts and moves, state probabilities by place (states first), and the log10 likelihood of all."""
    rows = packed.rows
    begin, last, end = joints(model, table, packed)
    emit = table[:, packed.flat[rows.token]]
    scale, alpha, _ = steps(model.move, emit, rows, begin[:, rows.order], True)
    likelihood = float(np.log10(scale).sum())
    emit /= scale
    end, beta, n_after = end[:, rows.order], np.empty_like(emit), 0
    moves = np.zeros_like(model.move)
    for t in range(len(rows.active) - 1, -1, -1):
        n, a, b = rows.active[t], rows.start[t], rows.start[t + 1]
        if n_after:
            ahead = emit[:, b : b + n_after]
            beta[:, a : a + n_after] = model.move @ ahead
            moves += alpha[:, a : a + n_after] @ ahead.T
        beta[:, a + n_after : a + n] = end[:, n_after:n]
        # From here on ``emit`` holds emission times backward value.
        emit[:, a : a + n] *= beta[:, a : a + n]
        n_after = n
    first = rows.active[0]
    if len(packed.later):
        of = np.empty(first, np.int64)
        of[rows.order] = np.arange(first)
        moves += last[:, packed.later - 1] @ emit[:, of[packed.later]].T
    alpha *= beta
    return alpha[:, :first][:, packed.nth[rows.order] == 0].sum(1), model.move * moves, alpha, likelihood


def expected(model: Model, packed: Packed) -> np.ndarray:
    """Expected counts of starts, moves and emissions over the sequences, flat."""
    return expected_and_likelihood(model, packed)[0]


def expected_and_likelihood(model: Model, packed: Packed) -> tuple[np.ndarray, float]:
    """The same counts, and the sequences' log10 likelihood."""
    starts, moves, gamma, likelihood = posterior(model, packed, np.ascontiguousarray(model.emit.T))
    symbols = packed.flat[packed.rows.token]
    emissions = np.stack([np.bincount(symbols, g, len(model.emit)) for g in gamma], 1)
    return np.concatenate([starts, moves.ravel(), emissions.ravel()]), likelihood


# -- encoded documents ---------------------------------------------------------------
ENCODED = "ids binary, at binary, buckets binary"


def flat_bytes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column end to end, and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind), np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of HELD_TOKENS tokens at most, or of one document. Its first column is ``ids``."""
    sizes = pc.binary_length(batch.column(0)).to_numpy() // 2
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > HELD_TOKENS:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if held:
        yield batch.slice(at, len(sizes) - at)


class Documents:
    """The first three columns of a slice as numbers: token ids, and for those beyond the known ones their place among the slice's others."""

    def __init__(self, part: pa.RecordBatch) -> None:
        ids, self.lengths = flat_bytes(part.column(0), np.uint16)
        at, uses = flat_bytes(part.column(1), np.int32)
        self.buckets, self.others = flat_bytes(part.column(2), np.uint8)
        self.first_other = np.cumsum(self.others) - self.others
        self.ids = ids.astype(np.int64)
        self.ids[ids == KNOWN] = KNOWN + at + np.repeat(self.first_other, uses)

    def symbols(self, class_of: np.ndarray) -> np.ndarray:
        return np.concatenate([class_of, 1 + OWN + self.buckets.astype(np.int64)])[self.ids]

    def packed(self, symbols: np.ndarray) -> Packed:
        return Packed(symbols, self.lengths)


def encode(docs: DataFrame, own: dict[bytes, int]) -> DataFrame:
    """uid, doc_id, held_out, ids (16 bits a token), and of tokens without a number: the distinct ones, their hashed classes, and which one each is."""
    shared = docs.sparkSession.sparkContext.broadcast(own)  # KNOWN tokens at most
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, places, buckets, rest = [], [], [], []
                for t in part.column(1).to_pylist():
                    words = tokens_of(t)
                    numbers = np.fromiter(map(of.get, words, repeat(KNOWN)), np.uint16, len(words))
                    ids.append(numbers.tobytes())
                    seen: dict[bytes, int] = {}
                    which = [seen.setdefault(words[i], len(seen)) for i in np.flatnonzero(numbers == KNOWN).tolist()]
                    places.append(np.array(which, np.int32).tobytes())
                    buckets.append(bytes(zlib.crc32(w) % HASHED for w in seen))
                    rest.append(list(seen))
                uids = pa.array(np.arange(uid, uid + len(ids), dtype=np.int64))
                uid += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [uids, part.column(0), part.column(2), *[pa.array(x, pa.binary()) for x in (ids, places, buckets)], pa.array(rest, pa.list_(pa.binary()))],
                    ["uid", "doc_id", "held_out", "ids", "at", "buckets", "others"],
                )

    d = docs.select("doc_id", "text", (id_residue(FOLDS) == HELD_OUT).alias("held_out"))
    return d.mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, {ENCODED}, others array<binary>")


def neighbours(train: DataFrame, class_of: np.ndarray) -> np.ndarray:
    """Counts of (class, right neighbour's class, the rarer ones as one) over all training documents."""
    held = train.sparkSession.sparkContext.broadcast(class_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * RIGHT, np.int64)
        for batch in batches:
            for part in parts(batch):
                d = Documents(part)
                symbols = d.symbols(held.value)
                inside = np.ones(len(symbols), bool)
                inside[np.cumsum(d.lengths) - 1] = False  # a text's end has no right neighbour
                left = np.flatnonzero(inside)
                total += np.bincount(symbols[left] * RIGHT + np.minimum(symbols[left + 1], RIGHT - 1), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["i", "n"])

    sums = train.select("ids", "at", "buckets").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # CLASSES * RIGHT numbers at most
    out = np.zeros(CLASSES * RIGHT)
    out[sums.column("i").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(CLASSES, RIGHT)


def improved(encoded: DataFrame, model: Model, base: np.ndarray, class_of: np.ndarray) -> tuple[Model, float, np.ndarray]:
    """One Baum-Welch pass over all of ``encoded``: partial counts by task, summed by Spark. Also the log10 likelihood under ``model``, and the counts."""
    held = encoded.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit, class_of))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *of_model, classes = held.value
        m, total = Model(*of_model), None
        for batch in batches:
            for part in parts(batch):
                d = Documents(part)
                counts = np.append(*expected_and_likelihood(m, d.packed(d.symbols(classes))))
                total = counts if total is None else total + counts
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    sums = encoded.select("ids", "at", "buckets").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    states = len(model.start)
    counts = np.zeros(states + states * states + states * len(base) + 1)  # states * (states + classes + 1) numbers
    counts[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
    return Model.of_counts(counts[:-1], base, states), float(counts[-1]), counts[:-1]


def trained(train: DataFrame, model: Model, base: np.ndarray, tokens: int, class_of: np.ndarray, gain: float = GAIN) -> tuple[Model, Model, list[float]]:
    """The models before and after the last of the passes over all of ``train``, which end when one gains too little, and the likelihood a token before each pass."""
    reached: list[float] = []
    while len(reached) < 2 or reached[-1] - reached[-2] >= gain:
        before = model
        model, likelihood, _ = improved(train, before, base, class_of)
        reached.append(likelihood / tokens)
    return before, model, reached


def emission_counts(train: DataFrame, model: Model, class_of: np.ndarray) -> DataFrame:
    """id (of a known token, else null), token (of another, else null), c, q0, q1, ...: occurrences, and expected ones by state in PARTS, of every training token; the last state has what is left of c."""
    held = train.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit, class_of))
    names = ["c", *(f"q{s}" for s in range(len(model.start) - 1))]

    def rows(ids, tokens, counts: np.ndarray) -> pa.RecordBatch:
        n = counts.shape[1]
        columns = [pa.nulls(n, pa.int32()) if ids is None else pa.array(ids, pa.int32()), pa.nulls(n, pa.binary()) if tokens is None else tokens]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(c.astype(np.int64)) for c in counts]], ["id", "token", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *of_model, classes = held.value
        m = Model(*of_model)
        table = np.ascontiguousarray(m.emit.T)
        known = np.zeros((len(names), KNOWN))
        for batch in batches:
            for part in parts(batch):
                d = Documents(part)
                packed = d.packed(d.symbols(classes))
                gamma = np.rint(posterior(m, packed, table)[2][:-1] * PARTS)
                over = gamma.sum(0) - PARTS  # by rounding, a few parts at most
                i = np.flatnonzero(over > 0)
                gamma[gamma[:, i].argmax(0), i] -= over[i]
                ids = d.ids[packed.rows.token]
                counts = np.stack([np.bincount(ids, w, KNOWN + len(d.buckets)) for w in (None, *gamma)])
                known += counts[:, :KNOWN]
                if len(d.buckets):
                    others = part.column(3).flatten().dictionary_encode()
                    which = others.indices.to_numpy()
                    yield rows(None, others.dictionary, np.stack([np.bincount(which, w, len(others.dictionary)) for w in counts[:, KNOWN:]]))
        some = np.flatnonzero(known[0])
        yield rows(some, None, known[:, some])

    each = train.select("ids", "at", "buckets", "others").mapInArrow(run, ", ".join(["id int", "token binary", *(f"{c} long" for c in names)]))
    return each.groupBy("id", "token").agg(*[F.sum(c).alias(c) for c in names])


def score(docs: DataFrame, states: int = STATES, gain: float = GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    counts = stored(token_counts(docs.where(id_residue(FOLDS) != HELD_OUT)), "lm-counts")
    own = {END: 0}
    c_known = [0]
    for r in most_frequent(counts, KNOWN - 1):
        if bytes(r["token"]) == END:
            c_known[0] = r["c"]
        else:
            own[bytes(r["token"])] = len(own)
            c_known.append(r["c"])
    class_of = np.array([i if i <= OWN else 1 + OWN + zlib.crc32(t) % HASHED for t, i in own.items()] + [0] * (KNOWN - len(own)), np.int64)
    c_known = np.array(c_known + [0] * (KNOWN - len(own)), float)
    named = spark.createDataFrame([(k, v) for k, v in own.items() if v <= OWN], "token binary, class int")
    by_class = counts.join(F.broadcast(named), "token", "left").groupBy(F.coalesce("class", hashed_class()).alias("class")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class.collect():  # one row per class
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    total, distinct = int(n_class.sum()), int(v_class.sum())
    prior = (n_class + 0.5) / (n_class + 0.5).sum()

    encoded = stored(encode(docs, own), "lm-encoded")
    train = encoded.where("NOT held_out").select("ids", "at", "buckets", "others")
    model = before = Model.first(states, prior, neighbours(train, class_of))
    if total:
        before, model, _ = trained(train, model, prior, total, class_of, gain)
    table = stored(emission_counts(train, before, class_of), "lm-emissions")
    q = [f"q{s}" for s in range(states - 1)]

    def by_state(c, parts) -> np.ndarray:
        most = [np.asarray(x, float) / PARTS for x in parts]
        return np.array([*most, np.asarray(c, float) - sum(most, np.zeros(np.shape(c)))])

    q_known = np.zeros((states, KNOWN))
    rows = table.where("id IS NOT NULL").toArrow()  # KNOWN rows at most
    q_known[:, rows.column("id").to_numpy()] = by_state(rows.column("c"), [rows.column(c) for c in q])
    sums = table.agg(F.sum("c"), *[F.sum(c) for c in q]).first()
    in_state = by_state(sums[0], sums[1:]) if total else np.zeros(states)
    smooth = float(distinct + HASHED)
    # A class of one token has no unseen ones; a hashed class keeps half a count for them.
    share = np.concatenate([np.ones(1 + OWN), np.zeros(HASHED)])
    of_class = (n_class + 0.5 * (v_class + 1))[1 + OWN :]

    def emission(c: np.ndarray, expected: np.ndarray, classes: np.ndarray) -> np.ndarray:
        hashed = np.maximum(classes - 1 - OWN, 0)
        tied = model.emit[classes].T * np.where(share[classes] > 0, 1.0, (c + 0.5) / of_class[hashed])
        return (expected + smooth * tied) / (in_state + smooth)[:, None]

    base_of = lambda c: np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    held = spark.sparkContext.broadcast((emission(c_known, q_known, class_of), base_of(c_known), c_known > 0))  # fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, seen = held.value
        for batch in batches:
            for part in parts(batch):
                d = Documents(part)
                found = part.column(5)
                rows = pc.list_value_length(found).fill_null(0).to_numpy(zero_copy_only=False)
                flat = found.flatten()
                at = np.repeat(d.first_other, rows) + flat.field("i").to_numpy()
                c, expected = np.zeros(len(d.buckets)), np.zeros((states, len(d.buckets)))
                c[at] = flat.field("c").to_numpy()
                expected[:, at] = by_state(c[at], [flat.field(name) for name in q])
                table = np.concatenate([known, emission(c, expected, 1 + OWN + d.buckets.astype(np.int64))], 1)
                hidden = forward(model, d.packed(d.ids), False, table)[0]
                starts = np.cumsum(d.lengths) - d.lengths
                by_text = lambda x: np.add.reduceat(x[d.ids], starts)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column(3), part.column(4), pa.array(d.lengths), pa.array(by_text(np.concatenate([seen, c > 0]).astype(np.int64))), pa.array(by_text(np.concatenate([base, base_of(c)]))), pa.array(hidden)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    asked = encoded.select("uid", F.posexplode("others").alias("i", "token"))
    found = asked.join(table.where("token IS NOT NULL").drop("id"), "token").groupBy("uid").agg(F.collect_list(F.struct("i", "c", *q)).alias("found"))
    d = encoded.drop("others").join(found, "uid", "left").select("ids", "at", "buckets", "doc_id", "held_out", "found")
    d = d.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return d.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
