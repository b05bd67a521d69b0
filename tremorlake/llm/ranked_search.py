"""Ranked lexical search over all documents by MaxScore with bounds for pairs of terms.

``index`` cuts the documents into shards (a bounded run of documents of one input partition) and writes a
row for each term of a shard with the documents that hold it; no text is shuffled. A search takes the queries
in blocks of bounded size. For a block, ``impacts`` turns the postings of the asked terms into impacts and, for
pairs of terms that stand next to each other in a query's order of weights, intersects their lists and stores
the largest joint impacts: one row for each shard. The tenth joint impact over all shards gives each
query a first threshold. ``search`` then walks each query's terms in every shard, from the heaviest. Terms left
are bounded together: the least over all ways of covering them by single terms (their maximum) and stored pairs
(the largest of the joint and both single maxima). Once that bound is below the threshold no new document is
taken in; those met already are dropped as soon as their score plus the bound of what is left cannot reach it,
and the remaining lists are only asked for the others. The threshold rises with the tenth best score so far.
Nothing that could be among the ten, ties included, is left out.

Terms are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased. NULL and wordless texts hold
none: such documents do not count and such queries find nothing. Each row of the documents counts as one, also
with a repeated or NULL id (last among ties). Queries equal in id and text are one; others with a repeated id
are ranked apart. Empty tables give no rows. Other columns are not read, so none can clash.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tremorlake.llm.common import running_total, ship, staged, text_of

TOP = 10
LENGTH_SHARE = 90  # per cent of a document's length penalty that follows its length
SHARD_DOCS, SHARD_TERMS = 1 << 12, 1 << 20  # documents and term occurrences after which a shard is closed
BLOCK_BYTES = 4 << 20  # query text that one block holds
#: ASCII bytes: letters and digits stay, capitals are lowered, all others part terms.
_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_POSTINGS = "shard bigint, term string, docs array<int>, counts array<int>, ids array<bigint>"
#: The lists of a shard, one after the other, as packed little-endian numbers: a shard is one small row to Spark.
_LISTS = {"terms": "<i4", "sizes": "<i4", "docs": "<i4", "impacts": "<i8", "pair_a": "<i4", "pair_b": "<i4", "pair_most": "<i8"}
_IMPACTS = f"shard bigint, ids array<bigint>, {', '.join(f'{c} binary' for c in _LISTS)}, tops array<struct<a:int,b:int,impacts:array<bigint>>>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWERED).split()


# ---------------------------------------------------------------- index


def index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The written index: a row for each (shard, term), and one without a term that lists the shard's documents.

    ``docs`` are places inside the shard, ``counts`` occurrences; in the row without a term ``counts`` are the
    documents' lengths and ``ids`` their doc_ids.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, codes, sizes, held = [], [], [], 0
        words: defaultdict[bytes, int] = defaultdict()
        words.default_factory = words.__len__

        def closed() -> pa.RecordBatch:
            length = np.array(sizes, np.int64)
            keys = np.concatenate(codes) << 32 | np.repeat(np.arange(len(length)), length)
            keys, counts = np.unique(keys, return_counts=True)
            ends = np.searchsorted(keys, np.arange(1, len(words) + 1) << 32)
            offsets = np.concatenate([[0], ends, [len(keys) + len(length)]]).astype(np.int32)
            flat = np.concatenate([keys & 0xFFFFFFFF, np.arange(len(length))]).astype(np.int32)
            counts = np.concatenate([counts, length]).astype(np.int32)
            names = [w.decode("utf-8", "replace") for w in words] + [None]
            none = np.zeros(len(names) + 1, np.int32)
            none[-1] = len(ids)
            columns = [
                pa.array(np.full(len(names), (part << 32) + number)),
                pa.array(names, pa.string()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts)),
                pa.ListArray.from_arrays(pa.array(none), pa.array(ids, pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["shard", "term", "docs", "counts", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                ids.append(doc)
                sizes.append(len(found))
                codes.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                held += len(found)
                if len(ids) == shard_docs or held >= shard_terms:
                    yield closed()
                    number += 1
                    ids, codes, sizes, held = [], [], [], 0
                    words.clear()
        if ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(text_of(), "utf-8").alias("text"))
    return staged(rows.mapInArrow(run, _POSTINGS), "index")


# ---------------------------------------------------------------- queries


@dataclass
class Block:
    """Queries of bounded total size with what all shards need to know about their terms."""

    names: list[tuple]  # item_id and text hash of each query
    queries: list[list[int]]  # terms of each, the lightest first
    weights: list[int] = field(default_factory=list)  # of each term
    floors: list[int] = field(default_factory=list)  # threshold of each query
    n_docs: int = 0
    n_terms: int = 0

    def pairs(self) -> list[tuple[int, int]]:
        return sorted({p for q in self.queries for p in pairwise(q)})


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def penalties(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - LENGTH_SHARE + LENGTH_SHARE * lengths.astype(np.int64) * n_docs // max(n_terms, 1)


def _impact(weight_: int, counts: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.int64)
    return weight_ * (1_000_000_000 * counts // (1000 * counts + 8 * penalty))


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted arrays' common values and their places in both."""
    if len(a) > len(b):
        found, at_b, at_a = _common(b, a)
        return found, at_a, at_b
    at = np.searchsorted(b, a)
    met = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a) if len(b) else np.empty(0, np.int64)
    return a[met], met, at[met]


# ---------------------------------------------------------------- impacts and pairs


def _shard_impacts(table: pa.Table, block: Block, codes: dict[str, int]) -> tuple[list, dict, dict]:
    """A shard's doc_ids, impacts by term, and joint impacts by pair."""
    names, docs, counts = table.column("term").to_pylist(), table.column("docs").combine_chunks(), table.column("counts").combine_chunks()
    own = names.index(None)
    ids = table.column("ids").combine_chunks()[own].as_py()
    penalty = penalties(counts[own].values.to_numpy(), block.n_docs, block.n_terms)
    single = {}
    for at, name in enumerate(names):
        if name is not None and block.weights[codes[name]] > 0:
            places = docs[at].values.to_numpy()
            single[codes[name]] = (places, _impact(block.weights[codes[name]], counts[at].values.to_numpy(), penalty[places]))
    joint = {}
    for a, b in block.pairs():
        if a in single and b in single:
            found, at_a, at_b = _common(single[a][0], single[b][0])
            joint[a, b] = (found, single[a][1][at_a] + single[b][1][at_b])
    return ids, single, joint


def impacts(postings: DataFrame, block: Block, codes: dict[str, int]) -> DataFrame:
    """A row for each shard: doc_ids, impact lists of terms, and of each pair's intersection the largest impacts."""
    shared = postings.sparkSession.sparkContext.broadcast((block, codes))
    top_kind = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("impacts", pa.list_(pa.int64()))])

    def lists(parts: list[np.ndarray], value: pa.DataType) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, value))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        asked, known = shared.value
        ids, single, joint = _shard_impacts(table, asked, known)
        tops = [(*k, -np.sort(-v[1])[:TOP]) for k, v in joint.items() if len(v[1])]
        parts = {"terms": [list(single)], "sizes": [[len(d) for d, _ in single.values()]]}
        parts |= {"docs": [d for d, _ in single.values()], "impacts": [i for _, i in single.values()]}
        # Of a pair's intersection the search needs the largest joint impact, the thresholds the ten largest.
        parts |= {"pair_a": [[a for a, _ in joint]], "pair_b": [[b for _, b in joint]]}
        parts["pair_most"] = [[int(both.max(initial=0)) for _, both in joint.values()]]
        packed = [np.concatenate([np.empty(0, kind), *(np.asarray(p, kind) for p in parts[c])]).tobytes() for c, kind in _LISTS.items()]
        best = pa.StructArray.from_arrays([*(pa.array([t[n] for t in tops], pa.int32()) for n in (0, 1)), lists([t[2] for t in tops], pa.int64())], fields=list(top_kind))
        columns = [
            pa.array([key[0].as_py()], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            *(pa.array([p], pa.binary()) for p in packed),
            pa.ListArray.from_arrays(pa.array([0, len(best)], pa.int32()), best),
        ]
        return pa.Table.from_arrays(columns, ["shard", "ids", *_LISTS, "tops"])

    # A shard's rows are bounded by its documents and the block's terms.
    return staged(postings.groupBy("shard").applyInArrow(run, _IMPACTS), "impacts")


def floors(found: DataFrame, block: Block) -> list[int]:
    """A threshold for each query that ten documents surely reach: the tenth joint impact of its best pair."""
    tops = found.select(F.explode("tops").alias("t")).select("t.a", "t.b", F.explode("t.impacts").alias("impact"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("impact")))
    tenth = tops.withColumn("place", place).where(F.col("place") == TOP)
    known = {(r.a, r.b): r.impact for r in tenth.collect()}  # a number for each pair of the block
    return [max((known.get(p, 0) for p in pairwise(q)), default=0) for q in block.queries]


# ---------------------------------------------------------------- search


class Shard:
    """Impact lists of one shard, and queries over them."""

    def __init__(self, n_docs: int, single: dict, joint: dict, use_pairs: bool = True) -> None:
        self.n_docs, self.single = n_docs, single
        self.most = {t: int(v[1].max()) for t, v in single.items()}
        self.pair_most = {}
        for (a, b), (_, both) in joint.items() if use_pairs else ():
            self.pair_most[a, b] = max(int(both.max(initial=0)), self.most[a], self.most[b])
        self.read = 0  # list entries looked at, for tests and reports

    def bounds(self, terms: list[int]) -> list[int]:
        """bounds[i]: what the first i terms can add to a score at most."""
        out = [0]
        for i, term in enumerate(terms):
            best = out[i] + self.most[term]
            pair = self.pair_most.get((terms[i - 1], term)) if i else None
            out.append(best if pair is None else min(best, out[i - 1] + pair))
        return out

    def search(self, query: list[int], floor: int, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, floor): all that may be among the ``top``, and the raised threshold."""
        terms = [t for t in query if t in self.single]
        bound = self.bounds(terms)
        score = np.zeros(self.n_docs, np.int64)
        floor, left = max(floor, 1), len(terms)
        while left and bound[left] >= floor:  # a document first met here may still reach the threshold
            left -= 1
            docs, impact = self.single[terms[left]]
            self.read += len(docs)
            score[docs] += impact
            floor = max(floor, self._reached(score[score > 0] if left % 4 == 0 else impact, top))
        docs = np.flatnonzero(score)
        while True:
            docs = docs[score[docs] + bound[left] >= floor]
            if not left or not len(docs):
                break
            left -= 1
            places, impact = self.single[terms[left]]
            found, at, _ = _common(places, docs)
            self.read += min(len(places), len(docs))
            score[found] += impact[at]
            floor = max(floor, self._reached(score[docs], top))
        return docs, score[docs], floor

    @staticmethod
    def _reached(scores: np.ndarray, top: int) -> int:
        return int(np.partition(scores, len(scores) - top)[len(scores) - top]) if len(scores) >= top else 0


def _search_shards(found: DataFrame, block: Block, top: int) -> DataFrame:
    """(query, doc_id, score, shard, place): of each shard, what may be among the ``top`` of all."""
    shared = found.sparkSession.sparkContext.broadcast(block)
    schema = "query int, doc_id bigint, score bigint, shard bigint, place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        reach = list(asked.floors)  # thresholds rise from shard to shard of a task
        for batch in batches:
            for row in range(len(batch)):
                ids, single = batch.column(1)[row].as_py(), {}
                packed = {c: np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in _LISTS.items()}
                ends = np.cumsum(packed["sizes"])
                for term, start, end in zip(packed["terms"].tolist(), (ends - packed["sizes"]).tolist(), ends.tolist()):
                    single[term] = packed["docs"][start:end], packed["impacts"][start:end]
                pairs = zip(packed["pair_a"].tolist(), packed["pair_b"].tolist())
                joint = {pair: (None, packed["pair_most"][at : at + 1]) for at, pair in enumerate(pairs)}
                shard, out = Shard(len(ids), single, joint), []
                order = np.array([(1 << 63) - 1 if i is None else i for i in ids], np.int64)
                for at, query in enumerate(asked.queries):
                    places, scores, reach[at] = shard.search(query, reach[at], top)
                    best = np.lexsort((places, order[places], -scores))[:top]
                    out += [(at, ids[p], s, p) for p, s in zip(places[best].tolist(), scores[best].tolist())]
                columns = list(zip(*out)) or [[], [], [], []]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                columns.insert(3, [batch.column(0)[row].as_py()] * len(out))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in schema.split(", ")])

    return found.select("shard", "ids", *_LISTS).mapInArrow(run, schema)


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Distinct queries with the number of their block, and how many blocks there are."""
    rows = items.select(F.col("item_id"), text_of().alias("text")).distinct()
    rows = rows.withColumn("hash", F.xxhash64("text"))
    order = [F.col("item_id"), F.col("hash")]
    placed = running_total(rows, [], order, F.octet_length("text") + 64, "before")
    placed = staged(placed.withColumn("block", F.expr(f"before div {BLOCK_BYTES}")), "queries")
    last = placed.agg(F.max("block")).first()[0]
    return placed, 0 if last is None else last + 1


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    postings = index(docs)
    lengths = postings.where("term is null").select(F.explode("counts").alias("n")).where("n > 0")
    n_docs, n_terms = lengths.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    queries, n_blocks = _blocks(items)
    results = []
    for number in range(n_blocks):
        rows = queries.where(F.col("block") == number).collect()  # of BLOCK_BYTES, or one longer query
        asked = [sorted({t.decode("utf-8", "replace") for t in terms_of(r.text.encode())}) for r in rows]
        words = sorted(set().union(*asked))
        codes = {w: i for i, w in enumerate(words)}
        names = spark.createDataFrame(list(codes.items()), "word string, code int")
        mine = postings.join(F.broadcast(names), F.col("term") == F.col("word"), "left")
        mine = mine.where("word is not null or term is null").select("shard", "term", "docs", "counts", "ids")
        holding = mine.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("n"))
        known = {r.term: r.n for r in holding.collect()}  # a number for each term of the block
        weights = [weight(n_docs, known.get(w, 0)) for w in words]
        # The lightest first; equal weights by term, so that every shard and pair list has the same order.
        ordered = [sorted((codes[t] for t in terms), key=lambda c: (weights[c], c)) for terms in asked]
        block = Block([(r.item_id, r.hash) for r in rows], ordered, weights, [0] * len(rows), n_docs, n_terms)
        found = impacts(mine, block, codes)
        block.floors = floors(found, block)
        best = staged(_search_shards(found, block, top), "found")
        order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("shard"), F.asc("place")]
        place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
        best = best.withColumn("rank", place).where(F.col("rank") <= top)
        named = spark.createDataFrame([(i, n[0]) for i, n in enumerate(block.names)], f"number int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = best.join(F.broadcast(named), F.col("query") == F.col("number"))
        results.append(best.select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out
