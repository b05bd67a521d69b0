"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for two prime moduli, the hashes of all its prefixes. Two array entries
give the hash of any span, so spans compare in constant time and a binary search finds the longest
common extension of two positions. A fingerprint is the hash of the whole text and the 64 smallest
mixed hashes of its spans of 20 code points; the likeness of two fingerprints estimates the Jaccard
index of their spans (exact up to 64 spans).

NULL texts count as empty. Two empty texts are alike (1.0), an empty and another are not (0.0). A text
shorter than a span is one span. Equal texts have equal fingerprints. Rows with equal or NULL ids each
get a row of their own; NULL ids come last in descending order, ties go by a hash of the text.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tremorlake.llm.common import partitions, ship, text_of

SPAN = 20
KEPT = 64
_PRIMES = ((2147483647, 1103515245), (2147483629, 1299709213))  # modulus, base
_BITS = 40


class _Powers:
    """Powers of a base and of its inverse, long enough for any text asked for."""

    def __init__(self, modulus: int, base: int) -> None:
        self.modulus, self.base, self.inverse = modulus, base, pow(base, -1, modulus)
        self.up = self.down = np.ones(1, np.uint32)

    def _longer(self, have: np.ndarray, base: int, size: int) -> np.ndarray:
        while len(have) < size:
            step = np.uint64(pow(base, len(have), self.modulus))
            have = np.concatenate([have, (have * step % np.uint64(self.modulus)).astype(np.uint32)])
        return have

    def reach(self, size: int) -> None:
        self.up = self._longer(self.up, self.base, size)
        self.down = self._longer(self.down, self.inverse, size)


@cache
def _powers() -> tuple[_Powers, ...]:
    return tuple(_Powers(*prime) for prime in _PRIMES)


class PrefixHash:
    """Prefix arrays of one text; answers span equality and longest common extensions."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = len(codes)
        self.sums = []
        for p in _powers():
            p.reach(self.size + 1)
            m = np.uint64(p.modulus)
            terms = (codes.astype(np.uint64) + np.uint64(1)) * p.up[: self.size] % m
            sums = np.zeros(self.size + 1, np.uint32)
            # Each term is below 2**31, so 2**32 of them fit the 64-bit running sum.
            sums[1:] = np.cumsum(terms, dtype=np.uint64) % m
            self.sums.append(sums)

    def span(self, start: int, end: int) -> int:
        """Hash of the code points in [start, end), wherever they stand."""
        value = 0
        for p, sums in zip(_powers(), self.sums):
            part = (int(sums[end]) - int(sums[start])) * int(p.down[start]) % p.modulus
            value = value << 31 | part
        return value

    def extension(self, other: PrefixHash, start: int = 0, other_start: int = 0) -> int:
        """Length of the longest common extension from the two positions."""
        low, high = 0, min(self.size - start, other.size - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(other_start, other_start + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` code points; of the whole text if it is shorter."""
        width = min(width, self.size)
        if not width:
            return np.empty(0, np.uint64)
        value = np.zeros(self.size - width + 1, np.uint64)
        for p, sums in zip(_powers(), self.sums):
            m = np.uint64(p.modulus)
            part = (sums[width:] + m - sums[: len(sums) - width]) % m * p.down[: len(value)] % m
            value = value << np.uint64(31) | part
        return value


def sketch(prefix: PrefixHash, width: int = SPAN, kept: int = KEPT) -> np.ndarray:
    """The ``kept`` smallest distinct mixed span hashes, ascending."""
    mixed = prefix.spans(width)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - _BITS)
    want = 2 * kept
    while len(mixed) > want:  # repeated spans may leave too few distinct values
        few = np.unique(np.partition(mixed, want)[:want])
        if len(few) >= kept:
            return few[:kept]
        want *= 4
    return np.unique(mixed)[:kept]


def fingerprint(prefix: PrefixHash, smallest: np.ndarray) -> str:
    """Length, hash of the whole text and sketch, in hexadecimal."""
    whole = prefix.span(0, prefix.size) if prefix.size else 0
    return f"{prefix.size:x}-{whole:016x}-" + "".join(f"{v:010x}" for v in smallest.tolist())


def likeness(a: str, b: str, kept: int = KEPT) -> float:
    """Estimated Jaccard index of the spans behind two fingerprints."""
    if a == b:
        return 1.0
    one, two = ({x[i : i + 10] for i in range(0, len(x), 10)} for x in (a.split("-")[2], b.split("-")[2]))
    both = sorted(one | two)[:kept]
    return sum(v in one and v in two for v in both) / len(both) if both else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("prefix_edited", T.LongType()),
        T.StructField("prefix_next", T.LongType()),
    ]
)


class _Printed:
    def __init__(self, text: str) -> None:
        self.text = text
        self.prefix = PrefixHash(text)
        self.print = fingerprint(self.prefix, sketch(self.prefix))


def _compare(doc_id: int | None, here: _Printed, following: _Printed) -> tuple:
    changed = _Printed(edited(here.text, following.text))
    return (
        doc_id,
        len(here.text),
        hashlib.sha256(changed.text.encode("utf-8", "surrogatepass")).hexdigest(),
        here.print,
        changed.print,
        likeness(here.print, changed.print),
        likeness(here.print, following.print),
        here.prefix.extension(changed.prefix),
        here.prefix.extension(following.prefix),
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one slice in order, the head of the next slice last; one row is carried along."""
    waiting = None  # (doc_id, printed) of the last row, which has no successor yet
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["tail"] and waiting is None:
                continue
            here = _Printed(row["text"])
            if waiting is not None:
                out.append(_compare(*waiting, here))
            waiting = None if row["tail"] else (row["doc_id"], here)
        yield pa.RecordBatch.from_pylist([dict(zip(_RESULT.names, r)) for r in out], to_arrow_schema(_RESULT))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, its edited text and their likeness; next is next by descending doc_id.

    Slices of the order are cut at keys taken from a range shuffle of the ids alone (one key per
    slice). Then the texts are shuffled once: each row goes to its slice, a slice's first row also to
    the slice before it, and the very first to the last. A task walks its sorted slice row by row.
    """
    lowest = -(1 << 63)
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    keys = rows.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(lowest)).alias("k"), F.xxhash64("text").alias("h")
    )
    order = [F.desc("k"), F.desc("h")]
    heads = (
        keys.select("k", "h")
        .repartitionByRange(partitions(docs.sparkSession), *order)
        .groupBy(F.spark_partition_id().alias("slice"))
        .agg(F.max(F.struct("k", "h")).alias("head"))
        .collect()
    )
    heads = sorted({(r.head.k, r.head.h) for r in heads})  # ascending; slice 0 has the largest keys
    count = max(1, len(heads))

    @F.pandas_udf("array<int>")
    def places(k: pd.Series, h: pd.Series) -> pd.Series:
        def of(key: tuple) -> list[int]:
            at = bisect.bisect_left(heads, key)  # the smallest head that is not before the key
            here = count - 1 - at
            return [2 * here, 2 * ((here - 1) % count) + 1] if heads[at] == key else [2 * here]

        return pd.Series([of(key) for key in zip(k.tolist(), h.tolist())])

    placed = keys.select("doc_id", "text", "k", "h", F.explode(places("k", "h")).alias("place"))
    placed = placed.select("*", F.shiftright("place", 1).alias("slice"), (F.col("place") % 2 == 1).alias("tail"))
    dealt = placed.repartitionById(count, F.col("slice")).sortWithinPartitions("tail", *order)
    return dealt.select("doc_id", "text", "tail").mapInArrow(_walk, _RESULT)
