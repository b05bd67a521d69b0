"""Self-join of documents by the Jaccard index of their word n-grams, with several token orders.

A pair whose index reaches the threshold shares a token among the first |x| - ceil(t |x|) + 1 tokens of
each set under any global order. The first order (rare tokens first) gives join keys; a candidate must
also share prefix tokens under two more orders, and the smaller counts of 64 bins of tokens, which bound
the intersection, must reach the threshold, before its whole texts are compared. Many documents around one text
share the same keys without being similar enough; what each has or lacks against one of them gives keys there
(``_differences``).

How many documents hold a token is counted exactly, up to ``FREQUENT``, beyond which order no longer matters.
Tokens travel packed: a run of documents sends each range of hashes its tokens of that range, and is told
which of them stand elsewhere, too. Tokens of one document alone come first and give no key. A token that is
frequent in the run itself is sent once with its number, so no range receives one token from all documents.

Documents with equal sets are one node. Words are runs of non-blanks, A-Z lower-cased. With fewer words
than n, the whole sequence is the one n-gram. NULL, empty and blank texts have an empty set and link
with nothing. Repeated and NULL ids count row by row; a component's id is its smallest non-NULL id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import partitions, passing, ship, staged, text_of
from tremorlake.llm.linking import link
from tremorlake.operators.sizing import broadcast_when_small

WORDS = 3
LEAST = 90  # per cent
FREQUENT = 64  # documents; all tokens of as many or more count as equally frequent
RUN_TOKENS, RUN_DOCS = 1 << 21, (1 << 16) - 1  # tokens and documents of a run
_LOW = 32  # bits of a hash that tell tokens of one range apart; a clash makes two tokens one, which adds candidates
_BINS = 6  # bits of a token's hash that choose its bin
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_REMEMBERED = 500_000


def mixed(values: np.ndarray, which: int) -> np.ndarray:
    """A permutation of 64-bit values for each ``which``."""
    out = (values ^ values >> np.uint64(31)) * np.uint64(_ODD[which])
    return out ^ out >> np.uint64(29)


class Shingler:
    """Distinct n-gram hashes of a text, sorted."""

    def __init__(self, width: int) -> None:
        self.width, self.words = width, {}

    def __call__(self, text: str) -> np.ndarray:
        # bytes.split and bytes.lower know ASCII only, as the definition of a word asks.
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > _REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(codes))
        value = np.full(len(codes) - width + 1, width, np.uint64)
        for i in range(width):
            value = mixed(value * np.uint64(_ODD[3]) + codes[i : i + len(value)], 0)
        return np.unique(value)


def prefix_size(size: int, least: int) -> int:
    return size - -(-least * size // 100) + 1


_RUN = "range bigint, run bigint, tokens binary, rows binary, counts binary, ids array<bigint>, md5s array<string>, sizes array<bigint>, digests array<binary>"
_KEYS = "doc_id bigint, md5 string, n bigint, digest binary, keys array<bigint>"


def _named(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def _send(range_: int, run: int, tokens=b"", rows=b"", counts=b"", ids=None, md5s=None, sizes=None, digests=None) -> tuple:
    return range_, run, tokens, rows, counts, ids, md5s, sizes, digests


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], _named(_RUN))


def _sent(part: int, number: int, held: list[tuple], bits: int) -> list[tuple]:
    """What a run sends: its documents, and the tokens of each range (sorted, with their rows).

    Tokens of ``FREQUENT`` documents of the run are known to be frequent: they stay with the documents, and the
    range gets one entry with their number.
    """
    run = (part << 32) + number
    ids, md5s, tokens = zip(*held)
    flat = np.concatenate(tokens)
    rows = np.repeat(np.arange(len(held), dtype=np.uint16), [len(t) for t in tokens])
    order = np.argsort(flat)
    flat, rows = flat[order] >> np.uint64(64 - bits - _LOW), rows[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(flat)])
    many = np.repeat(sizes >= FREQUENT, sizes)
    digests = [xxhash.xxh3_128_digest(t.tobytes()) for t in tokens]
    out = [_send(-1 - run, run, flat[many].tobytes(), rows[many].tobytes(), b"", list(ids), list(md5s), [len(t) for t in tokens], digests)]
    sole = ~many
    sole[starts] = True
    counts = np.where(many[sole], np.repeat(np.minimum(sizes, 1 << 30), sizes)[sole], 1).astype(np.int32)
    flat, rows = flat[sole], rows[sole]
    ranges = flat >> np.uint64(_LOW)
    edges = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(ranges) else np.empty(0, np.int64)
    low = (flat & np.uint64((1 << _LOW) - 1)).astype(np.uint32)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(flat)]):
        # Counts other than one are few and named by their places.
        more = np.flatnonzero(counts[a:b] != 1).astype(np.int32)
        out.append(_send(int(ranges[a]), run, low[a:b].tobytes(), rows[a:b].tobytes(), np.r_[more, counts[a:b][more]].astype(np.int32).tobytes()))
    return out


def _answered(table: pa.Table) -> pa.Table:
    """For one range: tells every run which of its tokens stand in other documents, too, and in how many."""
    range_, runs = table.column(0)[0].as_py(), table.column(1).to_pylist()
    if range_ < 0:  # a run's documents
        return table
    tokens = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column(2)]
    rows = [np.frombuffer(x.as_buffer(), np.uint16) for x in table.column(3)]
    flat = np.concatenate(tokens)
    counts, at = np.ones(len(flat), np.int64), 0
    for part, x in zip(tokens, table.column(4)):
        more = np.frombuffer(x.as_buffer(), np.int32).reshape(2, -1)
        counts[at + more[0]] = more[1]
        at += len(part)
    order = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
    total = np.add.reduceat(counts[order], starts)
    held = np.empty(len(flat), np.int64)
    held[order] = np.repeat(total, np.diff(np.r_[starts, len(flat)]))
    held[counts > 1] = 0  # the run knows that these are frequent
    found, at = [], 0
    for run, part, row in zip(runs, tokens, rows):
        here = held[at : at + len(part)]
        kept = here > 1
        if kept.any():
            found.append(_send(range_, run, part[kept].tobytes(), row[kept].tobytes(), np.minimum(here[kept], FREQUENT).astype(np.uint8).tobytes()))
        at += len(part)
    return pa.Table.from_batches([_batch(found)])


def _prefixes(table: pa.Table, least: int) -> pa.Table:
    """For one run: the keys of every document, its rarest tokens that other documents hold."""
    rows, keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    own = None
    for at, range_ in enumerate(table.column(0).to_pylist()):
        rows.append(np.frombuffer(table.column(3)[at].as_buffer(), np.uint16).astype(np.int64))
        if range_ < 0:
            own = at
            keys.append(np.frombuffer(table.column(2)[at].as_buffer(), np.uint64))
            counts.append(np.full(len(keys[-1]), FREQUENT, np.int64))
        else:
            low = np.frombuffer(table.column(2)[at].as_buffer(), np.uint32).astype(np.uint64)
            keys.append(low + np.uint64(range_ << _LOW))
            counts.append(np.frombuffer(table.column(4)[at].as_buffer(), np.uint8).astype(np.int64))
    row, key, count = np.concatenate(rows), np.concatenate(keys), np.concatenate(counts)
    ids, md5s, sizes, digests = (table.column(c)[own].as_py() for c in (5, 6, 7, 8))
    order = np.lexsort((mixed(key, 0), count, row))
    row, key = row[order], key[order]
    shared = np.bincount(row, minlength=len(ids))
    place = np.arange(len(row)) - np.repeat(np.cumsum(shared) - shared, shared)
    size = np.array(sizes, np.int64)
    take = np.where(size > 0, size - -(-least * size // 100) + 1 - (size - shared), 0)  # the others stand in no other document
    kept = place < take[row]
    offsets = np.r_[0, np.cumsum(np.bincount(row[kept], minlength=len(ids)))].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[kept].view(np.int64)))
    columns = [pa.array(ids, pa.int64()), pa.array(md5s, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists]
    return pa.Table.from_arrays(columns, _named(_KEYS))


def _keyed(docs: DataFrame, width: int, least: int) -> DataFrame:
    """Per row the set's size and hash, and its keys: two shuffles of packed tokens, none of texts."""
    bits = max(6, (4 * partitions(docs.sparkSession) - 1).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, part, number, held, size = Shingler(width), TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc, md5, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.append((doc, md5, shingles(text.as_py())))
                size += len(held[-1][2])
                if size >= RUN_TOKENS or len(held) == RUN_DOCS:
                    yield _batch(_sent(part, number, held, bits))
                    number, held, size = number + 1, [], 0
        if held:
            yield _batch(_sent(part, number, held, bits))

    def keys(table: pa.Table) -> pa.Table:
        return _prefixes(table, least)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text_of()).alias("md5"), text_of().alias("text"))
    answers = rows.mapInArrow(send, _RUN).groupBy("range").applyInArrow(_answered, _RUN)
    return answers.groupBy("run").applyInArrow(keys, _KEYS)


def _signatures(docs: DataFrame, asked: DataFrame, width: int, least: int) -> DataFrame:
    """(node, size, second, third, spread) of the asked nodes: prefixes under two more orders, and bins."""
    schema = "node bigint, size bigint, second array<smallint>, third array<smallint>, spread array<int>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            sizes, prefixes = [], ([], [], [])
            for text in batch.column(1).to_pylist():
                tokens = shingles(text)
                take = prefix_size(len(tokens), least) if len(tokens) else 0
                sizes.append(len(tokens))
                for which in (1, 2):
                    ranked = mixed(tokens, which)
                    if 0 < take < len(ranked):
                        ranked = np.partition(ranked, take - 1)[:take]
                    # Equal short forms of different tokens only let a candidate pass.
                    prefixes[which - 1].append((ranked & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16))
                places = (mixed(tokens, 3) >> np.uint64(64 - _BINS)).astype(np.int64)
                prefixes[2].append(np.bincount(places, minlength=1 << _BINS).astype(np.int32))
            arrays = [batch.column(0), pa.array(sizes, pa.int64())]
            for part, kind in zip(prefixes, (pa.int16(), pa.int16(), pa.int32())):
                offsets = np.zeros(len(part) + 1, np.int32)
                np.cumsum([len(x) for x in part], out=offsets[1:])
                flat = np.concatenate(part) if part else np.empty(0, np.int16)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind)))
            yield pa.RecordBatch.from_arrays(arrays, _named(schema))

    return _texts_of(docs, asked).mapInArrow(sign, schema)


def _texts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, text) of nodes, each by the row that stands for it."""
    asked = broadcast_when_small(staged(asked, "asked"), max_bytes=16 << 20)
    texts = docs.select(F.md5(text_of()).alias("md5"), F.col("doc_id").cast("bigint").alias("id"), text_of().alias("text"))
    found = texts.join(asked, (F.col("md5") == F.col("rep_md5")) & F.col("id").eqNullSafe(F.col("rep_id")))
    return found.select("node", "text").dropDuplicates(["node"])


def _verifier(docs: DataFrame, nodes: DataFrame, width: int, least: int):
    """Keeps the pairs of nodes whose whole texts reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        last, left = None, None
        for batch in batches:
            good = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, left = a, shingles(one)
                right = shingles(two)
                both = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * both >= least * (len(left) + len(right) - both))
            kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])
            yield kept.filter(pa.array(good, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("of")).union(pairs.select(F.col("b").alias("of"))).distinct()
        asked = asked.join(nodes, F.col("of") == F.col("node")).select("node", "rep_md5", "rep_id")
        found = staged(_texts_of(docs, asked), "texts")
        one = found.select(F.col("node").alias("l"), F.col("text").alias("one"))
        two = found.select(F.col("node").alias("r"), F.col("text").alias("two"))
        met = pairs.join(one, F.col("a") == F.col("l")).join(two, F.col("b") == F.col("r"))
        return met.select("a", "b", "one", "two").mapInArrow(check, "a bigint, b bigint")

    return verify


def _differing(docs: DataFrame, nodes: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """``asked`` (a, b, ...) with the sizes of both sets and the tokens that only one of them holds."""
    schema = "a bigint, b bigint, l_comp bigint, r_comp bigint, l_size bigint, r_size bigint, tokens array<bigint>"

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, leaders = Shingler(width), {}
        for batch in batches:
            apart, sizes = [], ([], [])
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(4), batch.column(5)):
                if a not in leaders:
                    if len(leaders) == 16:
                        leaders.clear()
                    leaders[a] = shingles(one.as_py())
                right = shingles(two.as_py())
                apart.append(np.setxor1d(leaders[a], right, assume_unique=True))
                sizes[0].append(len(leaders[a]))
                sizes[1].append(len(right))
            flat = np.concatenate([np.empty(0, np.uint64), *apart]).view(np.int64)
            offsets = pa.array(np.cumsum([0, *map(len, apart)]).astype(np.int32))
            tokens = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(s, pa.int64()) for s in sizes), tokens], _named(schema))

    of = asked.select(F.col("a").alias("of")).union(asked.select(F.col("b").alias("of"))).distinct()
    of = of.join(nodes, F.col("of") == F.col("node")).select("node", "rep_md5", "rep_id")
    texts = staged(_texts_of(docs, of), "texts")
    # Leaders are few and have many rows each: their texts go to the rows if they measure small.
    lead = texts.join(asked.select(F.col("a").alias("of")).distinct(), F.col("node") == F.col("of"), "left_semi")
    lead = broadcast_when_small(lead.select(F.col("node").alias("l"), F.col("text").alias("one")), max_bytes=16 << 20)
    two = texts.select(F.col("node").alias("r"), F.col("text").alias("two"))
    met = asked.join(two, F.col("b") == F.col("r")).join(lead, F.col("a") == F.col("l"))
    return met.select("a", "b", "l_comp", "r_comp", "one", "two").mapInArrow(differ, schema)


def _differences(docs: DataFrame, nodes: DataFrame, width: int, least: int):
    """Candidates among the rows of a leader, by the tokens in which they differ from it.

    With D(x) the tokens that only one of x and the leader holds, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|
    tokens. They are linked if that is at most ``room`` = (100 - t) / (100 + t) of their summed sizes, so D(x) and D(y)
    share at least half of |D(x)| + |D(y)| - room. If x is not linked to the leader, D(x) alone exceeds what x and
    the leader may differ in, so that at least one token is shared, found in the rare prefixes of D(x) and D(y).
    Two rows that are both linked to the leader are in one component and need no test.
    """
    give, all_ = 100 - least, 100 + least

    def differ(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = _differing(docs, nodes, asked, width).withColumn("d", F.size("tokens"))
        linked = (all_ * F.col("d") <= give * (F.col("l_size") + F.col("r_size"))).alias("linked")
        comp = F.when(linked, F.col("l_comp")).otherwise(F.col("r_comp")).alias("comp")
        rows = staged(rows.select("a", "b", comp, "l_size", F.col("r_size").alias("size"), "d", linked, "tokens"), "differences")
        links = rows.where("linked").select("a", "b")
        # The least that a row must share with one that is not linked to the leader, and (full) an unlinked row with any.
        rows = rows.withColumns({
            "least": F.expr(f"cast(greatest(1, floor(({all_} * d + {give} * (l_size - size)) / {2 * all_}) + 1) as int)"),
            "full": F.expr(f"cast(greatest(1, ceil(({all_} * d - {give} * (l_size + size)) / {2 * all_})) as int)"),
        })
        held = rows.select(F.col("a").alias("lead"), F.explode("tokens").alias("of")).groupBy("lead", "of").agg(F.count("*").alias("held"))
        tokens = rows.select("a", "b", F.explode("tokens").alias("token"))
        tokens = tokens.join(held, (F.col("a") == F.col("lead")) & (F.col("token") == F.col("of")))
        order = F.sort_array(F.collect_list(F.struct("held", "token"))).alias("order")
        order = tokens.groupBy("a", "b").agg(order).withColumnsRenamed({"a": "lead", "b": "of"})
        rows = rows.drop("tokens").join(order, (F.col("a") == F.col("lead")) & (F.col("b") == F.col("of")))
        taken = F.col("d") - F.when(F.col("linked"), F.col("least")).otherwise(F.least("least", "full")) + 1
        rows = rows.select("a", "b", "comp", "size", "d", "linked", "least", "full", F.posexplode(F.slice("order", 1, F.greatest(taken, F.lit(0)))).alias("at", "x"))
        rows = staged(rows.where("x.held > 1").select(*rows.columns[:-1], F.col("x.token").alias("token")), "tokens")
        short, whole = F.expr("at <= d - least"), F.expr("at <= d - full")

        def side(prefix: str, where) -> DataFrame:
            return rows.where(where).select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("a", "b", "comp", "size", "d", "at", "token")))

        share = F.expr(f"2 * least(l_d - l_at, r_d - r_at) >= l_d + r_d - floor({give} * (l_size + r_size) / {all_})")
        same = (F.col("l_a") == F.col("r_a")) & (F.col("l_token") == F.col("r_token")) & share
        apart = side("l", ~F.col("linked") & short).join(side("r", ~F.col("linked") & short), same & (F.col("l_comp") < F.col("r_comp")))
        mixed_ = side("l", ~F.col("linked") & whole).join(side("r", F.col("linked") & short), same & (F.col("l_comp") != F.col("r_comp")))
        found = apart.select("l_b", "r_b").union(mixed_.select("l_b", "r_b"))
        return links, found.select(F.col("l_b").alias("a"), F.col("r_b").alias("b")).distinct()

    return differ


def join(docs: DataFrame, width: int = WORDS, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; components of documents linked by similarity."""
    spark = docs.sparkSession
    ship(spark)
    with passing() as keep:
        rows = staged(_keyed(docs, width, least), "keyed")
        known = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "md5")
        sets = rows.groupBy("digest", "n").agg(F.min(known).alias("rep"), F.min("doc_id").alias("low"))
        sets = sets.withColumn("node", F.monotonically_increasing_id())
        sets = staged(
            sets.select("node", "digest", "n", "low", F.col("rep.md5").alias("rep_md5"), F.expr("nullif(rep.id, -9223372036854775808L)").alias("rep_id")),
            "sets",
        )
        same = (F.col("md5") == F.col("rep_md5")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
        nodes = rows.where("size(keys) > 0").join(sets, same).dropDuplicates(["node"])
        members = staged(nodes.select(F.explode("keys").alias("key"), "node", sets["n"].alias("size")), "members")
        counts = members.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select(F.col("key").alias("k"))
        members = staged(members.join(counts, F.col("key") == F.col("k"), "left_semi"), "members")
        live = members.select(F.col("node").alias("of")).distinct().join(sets, F.col("of") == F.col("node"))
        payload = staged(_signatures(docs, live.select("node", "rep_md5", "rep_id"), width, least), "signatures")

        def near():
            return 100 * F.least("l_size", "r_size") >= least * F.greatest("l_size", "r_size")

        def likely():
            most = F.aggregate(F.zip_with("l_spread", "r_spread", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
            bound = 100 * most >= least * (F.col("l_size") + F.col("r_size") - most)
            return F.arrays_overlap("l_second", "r_second") & F.arrays_overlap("l_third", "r_third") & bound

        roots = link(members, near, _verifier(docs, sets, width, least), payload, likely, spare=0, differ=_differences(docs, sets, width, least))
        if roots is None:
            placed = sets.withColumn("root", F.col("node"))
        else:
            roots = roots.withColumnRenamed("node", "of")
            placed = sets.join(roots, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node"))
        placed = staged(placed.select("digest", "n", "root", "low"), "placed")
        lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
        placed = placed.drop("low").join(lowest, "root").select(F.col("digest").alias("d"), F.col("n").alias("size"), "component_id")
        out = rows.join(placed, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("size")))
        # Rows with an empty set are linked with nothing, not even with each other.
        alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        return keep(staged(out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id")), "components"))
