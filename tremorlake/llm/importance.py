"""Importance resampling towards a target distribution over hashed word n-grams.

A feature is a run of one to three words, its bucket the CRC-32 of its bytes modulo ``BUCKETS``. Counts over
all documents and all target texts give each bucket a gain (log ratio, add-one smoothed, in thousandths,
rounded down). A document's weight is the sum of the gains of its features, looked up in one array; its score
adds a Gumbel number drawn from its id, so the highest scores are a draw without replacement.

Buckets are found once and written, two bytes a feature, as finding them is most of the work. So are scores. The cutoff is found by halving the range of scores: every job counts, exactly and over
all scores, at the points the next four halvings can ask for. Rows tied at the cutoff score are halved again by
doc_id, and rows equal in both by row number. The drawn rows alone are dealt by range for their ranks.

Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased. NULL, empty and wordless
texts have no features and weight 0. A NULL id hashes as an empty one and comes last among ties. Repeated ids
are rows of their own; which of rows equal in id and score is drawn follows the order of the input files. Without
eligible documents or target texts nothing fails: gains follow from the counts that there are. Other columns
are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import running_total, ship, staged, text_of

BUCKETS = 10_000
LONGEST = 3  # words of a feature
LEAST_WORDS = 20
PER_CENT = 5
SEED = 42
HALVINGS = 4  # that one job can decide
_REMEMBERED = 500_000
_PACKED = 32 << 20  # bytes of buckets in one batch, unless one text has more
_TABLED = 48  # bytes of a word whose shift is kept as a table
#: ASCII bytes: lower-case letters and digits stay, capitals are lowered, all others part words.
_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


class Featurizer:
    """Buckets of all features of a text.

    A feature's CRC follows from those of its words: crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where the shift
    is linear, so four table lookups move a whole array of CRCs.
    """

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.crc, self.size = np.empty(0, np.uint32), np.empty(0, np.int64)
        # tables[n][i][b]: the CRC of byte i of a CRC after n more bytes, as zlib combines them.
        one = np.array([[zlib.crc32(b"\0", b << 8 * i) ^ zlib.crc32(b"\0") for b in range(256)] for i in range(4)], np.uint32)
        none = np.array([[b << 8 * i for b in range(256)] for i in range(4)], np.uint32)
        tables = [none]
        for _ in range(_TABLED):
            tables.append(self._through(one[None], np.zeros(1024, np.int64), tables[-1].ravel()).reshape(4, 256))
        self.tables = np.stack(tables)

    @staticmethod
    def _through(tables: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
        out = tables[which, 0, crc & 255]
        for i in (1, 2, 3):
            out ^= tables[which, i, crc >> np.uint32(8 * i) & np.uint32(255)]
        return out

    def _shifted(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        while len(size) and size.max() > _TABLED:  # long words: as many steps as they need
            step = np.minimum(size, _TABLED)
            over = size > _TABLED
            crc = np.where(over, self._through(self.tables, step, crc), crc)
            size = np.where(over, size - step, size)
        return self._through(self.tables, size, crc)

    def __call__(self, text: bytes) -> tuple[np.ndarray, int]:
        """Buckets of the features, and how many words there are."""
        words = text.translate(_LOWERED).split()
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > _REMEMBERED:
            known.clear()
            self.crc, self.size = np.empty(0, np.uint32), np.empty(0, np.int64)
            new = set(words)
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.crc = np.concatenate([self.crc, np.fromiter(map(zlib.crc32, new), np.uint32, len(new))])
            self.size = np.concatenate([self.size, np.fromiter(map(len, new), np.int64, len(new))])
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        crc, size = self.crc[at], self.size[at]
        # Of the word with the blank before it: as if its CRC followed that of the blank.
        spaced = self._shifted(np.full(len(at), zlib.crc32(b" "), np.uint32), size) ^ crc
        runs = [crc]
        for n in range(1, min(LONGEST, len(at))):
            runs.append(self._shifted(runs[-1][:-1], size[n:] + 1) ^ spaced[n:])
        return np.concatenate(runs) % np.uint32(BUCKETS), len(words)


_FEATURIZER: list[Featurizer] = []


def featurizer() -> Featurizer:
    """Built once per worker."""
    if not _FEATURIZER:
        _FEATURIZER.append(Featurizer())
    return _FEATURIZER[0]


def featured(texts: DataFrame, *kept: Column, most: int = _PACKED) -> DataFrame:
    """``kept`` columns of every row, n_words, and the buckets of its features as packed 16-bit numbers."""

    def made(batch: pa.RecordBatch, words: list[int], found: list[bytes]) -> pa.RecordBatch:
        columns = [*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(found, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_words", "buckets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = featurizer()
        for batch in batches:
            start, size, words, found = 0, 0, [], []
            for at, text in enumerate(batch.column(batch.num_columns - 1)):
                buckets, n = features(text.as_py())
                words.append(n)
                found.append(buckets.astype(np.uint16).tobytes())
                size += len(found[-1])
                if size >= most:
                    yield made(batch.slice(start, len(words)), words, found)
                    start, size, words, found = at + 1, 0, [], []
            if words:
                yield made(batch.slice(start), words, found)

    rows = texts.select(*kept, F.encode(text_of(), "utf-8").alias("text"))
    schema = "".join(f"{name} {kind}, " for name, kind in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{schema}n_words bigint, buckets binary")


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of all ``featured`` rows fall into each bucket; a task sends at most ``BUCKETS`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for found in batch.column(0):
                total += np.bincount(np.frombuffer(found.as_buffer(), np.uint16), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counted = rows.select("buckets").mapInArrow(count, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths of a nat."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratios = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """A document's draw: the same wherever and whenever it is made."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(rows: DataFrame, table: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, row, n_words, n_features, weight, score) of every ``featured`` row."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(table)
    names = ["doc_id", "row", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            ids, counts, weights = batch.column(0).to_pylist(), [], []
            for packed in batch.column(3):
                found = np.frombuffer(packed.as_buffer(), np.uint16)
                counts.append(len(found))
                weights.append(int(gain[found].sum()))
            drawn = [w + gumbel(i, seed) for i, w in zip(ids, weights)]
            made = [pa.array(c, pa.int64()) for c in (counts, weights, drawn)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names)

    found = rows.select("doc_id", "row", "n_words", "buckets")
    return found.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def smallest_reaching(rows: DataFrame, value: Column, wanted: int) -> int:
    """The smallest value v such that at least ``wanted`` rows have ``value`` <= v, by halving with exact counts.

    ``rows`` hold at least that many. A job counts at the points that the next ``HALVINGS`` steps may ask for.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        points: list[int] = []
        ranges = [(low, high)]
        for _ in range(HALVINGS):
            below = []
            for a, b in ranges:
                if a < b:
                    middle = (a + b) // 2
                    points.append(middle)
                    below += [(a, middle), (middle + 1, b)]
            ranges = below
        counted = rows.agg(*(F.count_if(value <= p).alias(f"n{i}") for i, p in enumerate(points))).first()
        reached = dict(zip(points, counted))
        while low < high and (low + high) // 2 in reached:
            middle = (low + high) // 2
            low, high = (low, middle) if reached[middle] >= wanted else (middle + 1, high)
    return low


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document, ranked if drawn.

    One pass over the texts, which are never shuffled: their buckets are written, then counted and looked up.
    """
    ship(docs.sparkSession)
    kept = F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row")
    found = staged(featured(docs, *kept), "buckets")
    table = gains(bucket_counts(found), bucket_counts(featured(target)))
    rows = staged(scores(found, table, seed), "scores")
    fit = F.col("n_words") >= least_words
    wanted = rows.where(fit).count() * per_cent // 100
    # Smallest first in each of these; NULL ids last.
    known: list[Callable[[], Column]] = [lambda: -F.col("score"), lambda: F.coalesce("doc_id", F.lit((1 << 63) - 1)), lambda: F.col("row")]
    drawn, tied, left = F.lit(False), fit, wanted
    for value in known:
        if left == 0:
            break
        cut = smallest_reaching(rows.where(tied), value(), left)
        surely = tied & (value() < cut)
        drawn, tied = drawn | surely, tied & (value() == cut)
        left -= rows.where(surely).count()
        if rows.where(tied).count() == left:
            drawn, left = drawn | tied, 0
    taken = rows.where(drawn)
    ranked = running_total(taken, [], [v() for v in known], F.lit(1), "before").withColumn("rank", F.col("before") + 1)
    others = rows.where(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).union(others.select(*columns))
