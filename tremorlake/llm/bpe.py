"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut by the tokenizer's pattern. The distinct pieces of a batch are bucketed by byte length;
a bucket is one matrix with a row per piece. In each round every row finds the lowest rank among its
neighbouring pairs by a hashed lookup, merges the leftmost pair of that rank and closes the gap. Rows
without a pair leave the matrix. A piece above 256 bytes is a matrix of one row: it merges all pairs of
its lowest rank in one round, unless a merge brings up a lower rank, which is then taken one at a time.

NULL texts count as empty and have no ids; equal rows give equal rows. Special tokens are plain text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake.llm.common import ship, text_of

_NONE = np.int32(2**31 - 1)
_LONG = 256
_CELLS = 1 << 21  # of a matrix
_REMEMBERED = 100_000  # pieces, per task


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Encoder:
    """Encodes and decodes pieces of bytes by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self._build(np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: colliding keys move on by one until all have a slot of their own."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, 2**64 - 1, np.uint64), np.full(size, _NONE, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        self.probes = 1
        while len(left):
            free = self.keys[slots[left]] == np.uint64(2**64 - 1)
            self.keys[slots[left[free]]] = keys[left[free]]  # of several, the last stays
            own = self.keys[slots[left]] == keys[left]
            self.values[slots[left[own]]] = values[left[own]]
            left = left[~own]
            slots[left] = slots[left] + 1 & size - 1
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; the largest int where they don't merge or one is missing (-1)."""
        keys = left.astype(np.int64).astype(np.uint64) << np.uint64(32) | (right & 0x7FFFFFFF).astype(np.uint64)
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys, self.values[slots], _NONE)
        open_ = np.flatnonzero((found.ravel() == _NONE) & (self.keys[slots].ravel() != np.uint64(2**64 - 1)))
        flat, keys, slots = found.ravel(), keys.ravel(), slots.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            slots[open_] = slots[open_] + 1 & (1 << self.bits) - 1
            at = self.keys[slots[open_]]
            hit = at == keys[open_]
            flat[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (at != np.uint64(2**64 - 1))]
        found = flat.reshape(found.shape)
        found[(left < 0) | (right < 0)] = _NONE
        return found

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > _LONG:
                out[i] = self._long(piece)
            elif piece:
                buckets.setdefault((len(piece) + 3) // 4 * 4, []).append(i)
        for width, members in buckets.items():
            for start in range(0, len(members), max(1, _CELLS // width)):
                part = members[start : start + max(1, _CELLS // width)]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < size[:, None], self.bytes[raw], np.int32(-1))
        done: list[list[int]] = [[]] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of the smallest
            line = np.arange(len(rows))
            best = ranks[line, at]
            over = best == _NONE
            if over.any():
                for r, row, n in zip(rows[over].tolist(), ids[over].tolist(), size[over].tolist()):
                    done[r] = row[:n]
                keep = ~over
                rows, ids, size, ranks, at, best = (x[keep] for x in (rows, ids, size, ranks, at, best))
                line = np.arange(len(rows))
                if not len(rows):
                    break
            ids[line, at] = best
            # Close the gap: what stands right of the merged pair moves left by one.
            column = np.arange(ids.shape[1] - 1)
            ids[:, :-1] = np.where(column > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            column = np.arange(ranks.shape[1] - 1)
            ranks[:, :-1] = np.where(column > at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NONE
            size = size - 1
            last = ids.shape[1] - 1
            right = np.where(at < last, ids[line, np.minimum(at + 1, last)], np.int32(-1))
            inside = at < ranks.shape[1]
            ranks[line[inside], at[inside]] = self.rank(ids[line, at], right)[inside]
            before = line[at > 0]
            ranks[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], ids[before, at[before]])
            widest = max(2, int(size.max()))
            if widest <= ids.shape[1] - 4:  # compaction
                ids, ranks = ids[:, :widest].copy(), ranks[:, : widest - 1].copy()
        return done

    def _long(self, piece: bytes) -> list[int]:
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks):
            best = ranks.min()
            if best == _NONE:
                break
            at = np.flatnonzero(ranks == best)
            # Of touching pairs (aaa) only every second can merge, counted from the left.
            run = np.r_[True, np.diff(at) > 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            merged = self._merge(ids, at, best)
            fresh = self.rank(merged[:-1], merged[1:])
            between = self.rank(np.array([best]), ids[at[:1]])[0]  # before the next of touching pairs merges
            if len(at) > 1 and (between < best or len(fresh) and fresh.min() < best):
                merged = self._merge(ids, at[:1], best)
                fresh = self.rank(merged[:-1], merged[1:])
            ids, ranks = merged, fresh
        return ids.tolist()

    @staticmethod
    def _merge(ids: np.ndarray, at: np.ndarray, rank: np.int32) -> np.ndarray:
        out = ids.copy()
        out[at] = rank
        return np.delete(out, at + 1)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder of a rank file, built once per worker."""
    key = hashlib.sha256(data).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(parse_ranks(data))
    return _ENCODERS[key]


_RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)
_IDS = T.StructType([*_RESULT.fields[:1], T.StructField("ids", T.ArrayType(T.IntegerType()))])


class _Coder:
    """Encodes texts and remembers the pieces it has seen, up to a bound."""

    def __init__(self, data: bytes, pattern: str) -> None:
        self.encoder, self.pattern = encoder(data), regex.compile(pattern)
        self.known: dict[str, tuple[str, int, bytes, list[int]]] = {}

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces - self.known.keys())
        if len(self.known) + len(new) > _REMEMBERED:
            self.known.clear()
            new = list(pieces)
        for piece, ids in zip(new, self.encoder.encode([p.encode("utf-8", "surrogatepass") for p in new])):
            self.known[piece] = (" ".join(map(str, ids)), len(ids), self.encoder.decode(ids), ids)


def _batched(texts: list[str], coder: _Coder, chars: int = 1 << 21) -> Iterator[list]:
    """What the coder has for each text; pieces of about ``chars`` code points are learnt together."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        group = [coder.pattern.findall(t) for t in texts[start:end]]
        coder.learn(set().union(*group))
        for pieces in group:
            yield [coder.known[p] for p in pieces]
        start = end


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document the number of ids and digests of the ids and of the bytes they decode to.

    ``with_ids`` gives the ids instead of the digests. The rank file is read on the driver and sent to
    the workers; its size is that of the vocabulary. No shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as file:
        table = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(table.value, pattern)
        for batch in batches:
            ids, counts, digests, decoded = [], [], [], []
            for known in _batched(batch.column("text").to_pylist(), coder):
                if with_ids:
                    ids.append([i for k in known for i in k[3]])
                    continue
                counts.append(sum([k[1] for k in known]))
                digests.append(hashlib.sha256(" ".join([k[0] for k in known]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([k[2] for k in known])).hexdigest())
            if with_ids:
                columns, names = [pa.array(ids, pa.list_(pa.int32()))], _IDS.names
            else:
                columns, names = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], _RESULT.names
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, _IDS if with_ids else _RESULT)
