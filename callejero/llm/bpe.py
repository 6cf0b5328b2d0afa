"""Byte-pair encoding and decoding on contiguous rank arrays.

A short word keeps two arrays: its part ids (the boundaries) and the merge rank of each
adjacent pair. The smallest rank is found by a scan, its boundary is deleted, and the two
neighbouring ranks are refreshed. Words over ``SHORT`` bytes, where repeated scans would cost
their square, use a heap over linked parts instead; both merge in the same order.

Words repeat, so each Python worker keeps the encodings of words it has met, up to a bound.
Everything is row-local: no shuffle, and a lost executor costs its own partitions only.

Defined cases: a null text is encoded as the empty text (no tokens); special tokens' strings in
a text are those tokens; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SHORT = 128
#: Words that a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 200_000, 64
#: Documents handled at a time, which bounds a worker's memory.
SLICE = 256

#: How this kind of vocabulary cuts text before merging, and its white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """A byte-level vocabulary read from a tokenizer file's JSON."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.start = [0] * 256
        for letter, b in letters.items():
            self.start[b] = vocab[letter]
        #: Rank of a pair, by both ids in one number, and the id that each rank's merge makes.
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[left] << 32 | vocab[right], rank)
            self.made.append(vocab[left + right])
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content_, i in self.special.items():
            self.bytes_of[i] = content_.encode()
        self.cut = regex.compile(CUT).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        parts = [self.start[b] for b in word]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank_of, made, never = self.pairs.get, self.made, 1 << 60
        ranks = [rank_of(a << 32 | b, never) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            parts[i] = new = made[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(new << 32 | parts[i + 1], never)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | new, never)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank_of = len(parts), self.pairs.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.made[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := rank_of(parts[left] << 32 | parts[after[left]])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[after[left]]))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.merge(word.encode()))
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, extend = self.known, ids.extend
        for piece in self.split(text) if self.split else [text]:
            if piece in self.special:
                ids.append(self.special[piece])
                continue
            for word in self.cut(piece):
                extend(known.get(word) or self._word(word))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def read_tokenizer(path: str) -> str:
    """The tokenizer file's content, read by the driver; executors get it with the function."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _over_slices(docs: DataFrame, tokenizer: str, rows, schema: str) -> DataFrame:
    content = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))  # one vocabulary: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield rows(bpe, batch.slice(at, SLICE))

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(bpe: Bpe, part: pa.RecordBatch) -> pa.RecordBatch:
        ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return _over_slices(docs.select("doc_id", "text"), tokenizer, rows, f"doc_id {kind}, n_tokens long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text from doc_id, ids; special tokens are kept."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def rows(bpe: Bpe, part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.decode(i or []) for i in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return _over_slices(tokens.select("doc_id", "ids"), tokenizer, rows, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, in one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(bpe: Bpe, part: pa.RecordBatch) -> pa.RecordBatch:
        n, of_ids, of_text = [], [], []
        for t in part.column(1).to_pylist():
            ids = bpe.encode(t or "")
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _over_slices(docs.select("doc_id", "text"), tokenizer, rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
