"""Token ids as directly addressable codes, in files that give any token without decoding a block.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the lowest chunk of every id, level k the
k-th chunk of the ids that have one. A bitmap beside each level says which ids go on, and a rank directory
counts the set bits before every 512th, so the place in the next level is one lookup and at most eight words
of bits: an id is read with as many steps as it has chunks.

``write`` deals documents by range of doc_id (NULL first, equal ids by text), so that the files are in
ascending order; each task encodes its texts and packs whole documents into segments. A segment is one
self-contained piece of bytes (layout: ``pack``) in an uncompressed binary column of a Parquet file, so that
Spark's committer makes a repeated or speculative task harmless and any store that Spark reads will do. Beside
the segments stands a small table with each slice's first position in the whole sequence.

NULL texts count as empty and consist of the end id. Repeated rows are documents of their own, NULL ids too.
An empty table gives no segments. A document is never cut, so a segment holds at least one, however long.
Other columns are not read, so none can clash.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tremorlake.llm.common import partitions, ship, text_of

SEGMENT = 1 << 18  # ids after which a segment is closed
_MAGIC, _BITS, _BLOCK = b"DAC1", 8, 512
_REMEMBERED = 6_000_000  # ids that an encoder keeps for words it has seen
_JOINED = 50
#: Latin words: one piece for any tokenizer that splits letters from signs.
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
#: A stop or comma between such a letter or digit and white space: a piece of its own for the same tokenizers.
_STOP = re.compile(rb"[.,](?=[ \n]|\Z)(?:(?<=[A-Za-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")


# ---------------------------------------------------------------- codes


def pack(docs: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A segment: header, document directory, levels.

    Header: magic, documents, ids, levels (uint32, uint64, uint32). Directory: doc_ids (int64), a byte each for
    NULL ids, first places (uint64, one more than documents). Level: entries (uint64), chunks (uint8), and for all
    but the last its bitmap (uint64 words, lowest bit first) and rank directory (uint64, one per 512 bits).
    """
    rest = np.ascontiguousarray(ids, np.uint64)
    levels = []
    while True:
        more = rest >> np.uint64(_BITS)
        goes = more > 0
        levels.append(((rest & np.uint64((1 << _BITS) - 1)).astype(np.uint8), goes))
        rest = more[goes]
        if not len(rest):
            break
    out = [_MAGIC, np.uint32(len(docs)).tobytes(), np.uint64(len(ids)).tobytes(), np.uint32(len(levels)).tobytes()]
    out += [np.array([d or 0 for d in docs], "<i8").tobytes(), bytes(d is None for d in docs)]
    out.append(np.concatenate([[0], np.cumsum(sizes, dtype=np.uint64)]).astype("<u8").tobytes())
    for at, (chunks, goes) in enumerate(levels):
        out += [np.uint64(len(chunks)).tobytes(), chunks.tobytes()]
        if at < len(levels) - 1:
            bits = np.zeros(-(-len(goes) // _BLOCK) * _BLOCK, np.uint8)
            bits[: len(goes)] = goes
            counts = bits.reshape(-1, _BLOCK).sum(axis=1, dtype=np.uint64)
            ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u8")
            out += [np.packbits(bits, bitorder="little").tobytes(), ranks.tobytes()]
    return b"".join(out)


class Segment:
    """Views into the bytes of a segment; nothing is copied or decoded until asked for."""

    def __init__(self, data: bytes) -> None:
        view, place = memoryview(data), 0

        def take(kind: str, n: int = 1) -> np.ndarray:
            nonlocal place
            found = np.frombuffer(view, kind, n, place)
            place += found.nbytes
            return found

        if bytes(take("u1", 4)) != _MAGIC:
            raise ValueError("not a segment of token codes")
        n_docs, self.n_ids, n_levels = int(take("<u4")[0]), int(take("<u8")[0]), int(take("<u4")[0])
        self.doc_ids, self.no_id, self.first = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for at in range(n_levels):
            n = int(take("<u8")[0])
            chunks = take("u1", n)
            if at == n_levels - 1:
                self.levels.append((chunks, None, None))
            else:
                blocks = -(-n // _BLOCK)
                self.levels.append((chunks, take("<u8", blocks * _BLOCK // 64), take("<u8", blocks)))

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, at: int) -> int:
        """One id, by one step a level."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[at]) << shift
            shift += _BITS
            if bits is None or not int(bits[at >> 6]) >> (at & 63) & 1:
                break
            block = at // _BLOCK
            before = bits[block * _BLOCK // 64 : at >> 6]
            inside = int(bits[at >> 6]) & ((1 << (at & 63)) - 1)
            at = int(ranks[block]) + int(np.bitwise_count(before).sum()) + inside.bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level from the last."""
        value = np.zeros(0, np.uint64)
        for chunks, bits, _ in reversed(self.levels):
            below, value = value, chunks.astype(np.uint64)
            if bits is not None:
                goes = np.unpackbits(bits.view(np.uint8), count=len(chunks), bitorder="little").view(bool)
                value[goes] |= below << np.uint64(_BITS)
        return value

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, first place, end) of each document."""
        for doc, unknown, start, end in zip(self.doc_ids.tolist(), self.no_id.tolist(), self.first[:-1].tolist(), self.first[1:].tolist()):
            yield None if unknown else doc, start, end


# ---------------------------------------------------------------- encoding


class Encoder:
    """Ids of a text by the tokenizers library, which encodes each new word once.

    ``separable`` says that the tokenizer drops white space and that no piece of it spans any, or a Latin letter
    and a sign, so a text's ids are those of its words; whole texts are encoded otherwise.
    """

    def __init__(self, tokenizer: str, separable: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.separable = Tokenizer.from_str(tokenizer), separable
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.lower().encode() for t in special]
        probe = self.tokenizer.normalizer
        self.lower = probe is not None and probe.normalize_str("ABCXYZ") == "abcxyz"
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._forget()

    def lowers(self, text: bytes) -> bool:
        """Whether A-Z may be lowered beforehand: the tokenizer does so itself, and the text has neither special
        tokens, which are told by case, nor accents that could join a letter (U+0300 to U+033F).
        """
        return self.lower and b"\xcc" not in text and not any(word in text.lower() for word in self.special)

    def _forget(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__  # a new word gets the next number
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        decoded = [t.decode("utf-8", "replace") for t in texts]
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(decoded, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words, which follow those known. Words of one piece are encoded together and told apart by
        the tokens that end a word.
        """
        plain = [i for i, w in enumerate(words) if w.isalpha() or _PLAIN.fullmatch(w)]
        groups = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        order, sizes, flat = [], [], []
        for group, ids in zip(groups, self._encoded([b" ".join([words[i] for i in g]) for g in groups])):
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):  # else a tokenizer without word ends
                order += group
                sizes.append(np.diff(ends, prepend=0))
                flat.append(ids)
        done = set(order)
        left = [i for i in range(len(words)) if i not in done]
        flat += self._encoded([words[i] for i in left])
        sizes = np.concatenate([*sizes, np.array([len(x) for x in flat[len(flat) - len(left) :]], np.int64)]).astype(np.int64)
        first = np.empty((2, len(words)), np.int64)
        first[:, order + left] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        self.first, self.size = np.concatenate([self.first, first[0]]), np.concatenate([self.size, first[1]])
        self.flat = np.concatenate([self.flat, *flat])

    def _words(self, text: bytes) -> list[bytes]:
        """The text between ASCII white space, and stops and commas at the end of a word by themselves."""
        return _STOP.sub(rb" \g<0>", text.lower() if self.lowers(text) else text).split()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, given as UTF-8."""
        if not self.separable:
            return self._encoded(texts)
        if len(self.flat) > _REMEMBERED:
            self._forget()
        before, numbered = len(self.known), []
        for text in texts:
            words = self._words(text)
            numbered.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        if len(self.known) > before:
            self._learn(list(islice(reversed(self.known), len(self.known) - before))[::-1])
        out = []
        for at in numbered:
            first, sizes = self.first[at], self.size[at]
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
            out.append(self.flat[places])
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(tokenizer: str, separable: bool) -> Encoder:
    """The encoder of a tokenizer file, built once per worker."""
    if (tokenizer, separable) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer, separable] = Encoder(tokenizer, separable)
    return _ENCODERS[tokenizer, separable]


def _groups(texts: list[bytes], most: int = 1 << 21) -> Iterator[list[bytes]]:
    """Runs of texts of about ``most`` bytes, one text at least."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


# ---------------------------------------------------------------- files

_SEGMENT = "slice int, segment int, first bigint, n_docs bigint, n_ids bigint, low bigint, high bigint, data binary"


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, separable: bool = True, segment: int = SEGMENT) -> None:
    """Token ids of ``docs`` (doc_id, text) below ``path``: ``segments`` and ``slices``, both Parquet.

    The tokenizer file is read on the driver and sent to the workers; its size is that of the vocabulary. Texts
    are shuffled once, by range of doc_id; rows with equal ids are dealt by text and row, so that they spread.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        table = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(table.value, separable), TaskContext.get().partitionId()
        number = first = held = 0
        ids, sizes, names = [], [], []

        def closed() -> pa.RecordBatch:
            real = [n for n in names if n is not None]
            row = [part, number, first, len(names), held, min(real, default=None), max(real, default=None), pack(names, sizes, np.concatenate(ids))]
            kinds = [pa.int32()] * 2 + [pa.int64()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in _SEGMENT.split(", ")])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            docs_of = iter(batch.column("doc_id").to_pylist())
            for group in _groups(texts):
                for found in encode(group):
                    ids += [found, np.array([end_id], np.uint32)]
                    sizes.append(len(found) + 1)
                    names.append(next(docs_of))
                    held += len(found) + 1
                    if held >= segment:
                        yield closed()
                        number, first, held = number + 1, first + held, 0
                        ids, sizes, names = [], [], []
        if names:
            yield closed()

    text = F.encode(text_of(), "utf-8")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "tie", "row")
    rows = rows.sortWithinPartitions("doc_id", "tie", "text", "row").select("doc_id", "text")
    rows.mapInArrow(run, _SEGMENT).write.option("compression", "none").parquet(f"{path}/segments")
    # One row per slice; the file footers of the segments hold what is summed.
    totals = spark.read.parquet(f"{path}/segments").groupBy("slice").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = totals.select("slice", "n_ids", "n_docs", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("start"))
    slices.write.parquet(f"{path}/slices")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``, the place of their first id in the whole sequence."""
    slices = spark.read.parquet(f"{path}/slices").select(F.col("slice").alias("of"), F.col("start").alias("base"))
    rows = spark.read.parquet(f"{path}/segments")
    return rows.join(slices, F.col("slice") == F.col("of")).withColumn("start", F.col("base") + F.col("first"))


_DOCUMENT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; ``with_ids``: ids, too."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = Segment(data.as_buffer())
                ids = part.ids().astype("<u4")
                rows = [(doc, base + a, b - a, zlib.crc32(ids[a:b])) for doc, a, b in part.documents()]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(part.first, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    schema = _DOCUMENT + (", ids array<bigint>" if with_ids else "")
    return _segments(spark, path).select("start", "data").mapInArrow(run, schema)


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """(position, id) for every row of ``positions``; NULL beyond the sequence and for NULL.

    A segment and the positions asked of it meet by the stretches of ``SEGMENT`` ids that they lie in. Positions
    travel in lists of at most 65,536, so no hot segment gathers all of them, and a segment's bytes once per list.
    """
    spark = positions.sparkSession
    ship(spark)
    pieces = _segments(spark, path).select("slice", "segment", "start", "n_ids", F.explode(F.sequence(F.expr(f"start div {SEGMENT}"), F.expr(f"(start + n_ids - 1) div {SEGMENT}"))).alias("stretch"))
    asked = positions.select(F.col("position").cast("bigint").alias("position"), F.expr("monotonically_increasing_id() div 65536").alias("list"))
    inside = (F.expr(f"position div {SEGMENT}") == F.col("stretch")) & (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_ids"))
    met = asked.join(pieces, inside, "left")
    lists = met.where("slice is not null").groupBy("slice", "segment", "list", "start").agg(F.collect_list("position").alias("positions"))
    data = spark.read.parquet(f"{path}/segments").select(F.col("slice").alias("s"), F.col("segment").alias("g"), "data")
    lists = lists.join(data, (F.col("slice") == F.col("s")) & (F.col("segment") == F.col("g"))).select("start", "positions", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, places, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = Segment(data.as_buffer())
                found = [part[p - base] for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(found, pa.int64())], ["position", "id"])

    beyond = met.where("slice is null").select("position", F.lit(None).cast("bigint").alias("id"))
    return lists.mapInArrow(run, "position bigint, id bigint").union(beyond)
