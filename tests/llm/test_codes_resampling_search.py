"""Token codes, importance resampling and ranked search against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tremorlake.llm import importance, ranked_search, token_codes
from tremorlake.llm.common import scratch

PIECES = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "İi̇ ΑΣ ΣΑΣ. <|endoftext|>x a\x1cb ́a é \xa0q don't it's’s",
    "<|ENDOFTEXT|> ABC",
    "H̱ẖ Å. Éx,",
    "a.b. c,, d.. ñ. Ñ. É, 1. 2, x1. 'S 'Re It'S",
    "Aḇ. ǅ. ŉ, ß. ɏ. ĸ, ſ. ·. ×. ÷, Ω,\x85 x y. ª. º,",
    "日本語 ไทย 🙂🙂 \t\r\n mixed\x0bwhite\x0cspace",
    " ",
    "",
]


def test_segments_give_any_token():
    rnd = random.Random(3)
    ids = np.array([rnd.choice([rnd.randrange(256), rnd.randrange(1 << 16), rnd.randrange(1 << 32)]) for _ in range(5000)], np.uint64)
    part = token_codes.Segment(token_codes.pack([7, None, 9], [1000, 0, 4000], ids))
    assert len(part.levels) == 4 and (part.ids() == ids).all()
    assert [part[i] for i in range(5000)] == ids.tolist()
    assert list(part.documents()) == [(7, 0, 1000), (None, 1000, 1000), (9, 1000, 5000)]
    small = token_codes.Segment(token_codes.pack([1], [3], np.array([1, 2, 3], np.uint32)))
    assert len(small.levels) == 1 and [small[i] for i in range(3)] == [1, 2, 3]
    with pytest.raises(IndexError):
        small[3]
    with pytest.raises(ValueError):
        token_codes.Segment(b"none" + bytes(60))


def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("separable", [True, False])
def test_token_files(spark, documents, separable):
    rows = [(i * 3, t, "en", "s") for i, t in enumerate(HARD)]
    rows += [(5, None, None, None), (None, "no id", "en", "s"), (6, "twice", "en", "s"), (6, "twice", "en", "s"), (6, "Other text.", "en", "s")]
    rows += [(100, "long text, " * 30_000, "en", "s")]
    docs, tokenizer = documents(*rows), Tokenizer.from_file(PIECES)
    path = scratch(spark, "codes")
    token_codes.write(docs, PIECES, 2, path, separable, segment=50)
    got = token_codes.read(spark, path, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((d, tuple(encoded(tokenizer, t))) for d, t, *_ in rows)
    flat = []
    for r in got:
        assert (r["start"], r["n_tokens"]) == (len(flat), len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        flat += r["ids"]
    asked = [0, 1, len(flat) - 1, len(flat), -1, None, 7, 7, *range(0, len(flat), 991)]
    found = token_codes.tokens_at(spark.createDataFrame([(p,) for p in asked], "position bigint"), path)
    expected = Counter((p, flat[p] if p is not None and 0 <= p < len(flat) else None) for p in asked)
    assert Counter(tuple(r) for r in found.collect()) == expected


def test_no_documents_give_no_tokens(spark, documents):
    path = scratch(spark, "codes")
    token_codes.write(documents((1, "x", "en", "s")).limit(0), PIECES, 2, path)
    assert token_codes.read(spark, path).count() == 0


# ---------------------------------------------------------------- importance


def n_grams(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


@pytest.mark.parametrize("text", ["", "a", "Ab c", "a b c D's É x " * 5, "x" * 200 + " y " + "é" * 100 + " z", "[a]`b{c}\x7fd"])
def test_buckets_equal_the_plain_loop(text):
    found, n = importance.Featurizer()(text.encode())
    assert (n, sorted(found.tolist())) == (n_grams(text)[0], sorted(n_grams(text)[1]))


def resampled(rows, target, per_cent, least):
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(n_grams(text)[1])
    for text in target:
        t.update(n_grams(text)[1])
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(10_000)]
    out = []
    for doc, text, *_ in rows:
        n, found = n_grams(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    fit = sorted((-x[3], math.inf if x[0] is None else x[0]) for x in out if x[4])
    return [x[:4] for x in out], fit[: len(fit) * per_cent // 100]


@pytest.mark.parametrize("per_cent", [0, 5, 37, 100])
def test_resampling_equals_brute_force(spark, documents, per_cent):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "x1"]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(60))), "en", "s") for i in range(120)]
    rows += [(7, rows[7][1], "en", "s")] * 9 + [(None, rows[8][1], "en", "s")] * 3 + [(500, None, None, None), (501, "word " * 50_000, "en", "s")]
    target = [" ".join(rnd.choices(vocabulary[:10], k=30)) for _ in range(5)] + [None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = importance.resample(documents(*rows), bench, per_cent=per_cent).collect()
    every, drawn = resampled(rows, target, per_cent, 20)
    assert Counter(tuple(r)[:4] for r in got) == Counter(every)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r["score"], math.inf if r["doc_id"] is None else r["doc_id"]) for r in ranked] == drawn


def test_buckets_are_found_once_and_read_back(spark, documents):
    texts = ["a b c", None, "", "x " * 3000, "É é 1"]
    rows = documents(*((i, text, "en", "s") for i, text in enumerate(texts)))
    for most in (importance._PACKED, 2000):
        found = importance.featured(rows, F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(7).cast("bigint").alias("row"), most=most)
        assert found.columns == ["doc_id", "row", "n_words", "buckets"]
        read = {r["doc_id"]: (r["n_words"], sorted(np.frombuffer(bytes(r["buckets"]), np.uint16).tolist())) for r in found.collect()}
        assert read == {i: (n_grams(text)[0], sorted(n_grams(text)[1])) for i, text in enumerate(texts)}
    # Counts and weights need the buckets alone, no text.
    total = Counter(b for text in texts for b in n_grams(text)[1])
    assert dict(enumerate(importance.bucket_counts(found).tolist())) == {b: total[b] for b in range(importance.BUCKETS)}
    scored = importance.scores(found, np.ones(importance.BUCKETS, np.int64))
    assert {r["doc_id"]: r["weight"] for r in scored.collect()} == {i: len(n_grams(text)[1]) for i, text in enumerate(texts)}


def test_resampling_without_documents_or_target(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert importance.resample(documents((1, "x", "en", "s")).limit(0), none).count() == 0
    rows = [(i, "a b c " * 10, "en", "s") for i in range(20)]
    assert importance.resample(documents(*rows), none).where("rank is not null").count() == 1


# ---------------------------------------------------------------- search


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def searched(rows, items, top=10):
    docs = [(d, Counter(terms(t))) for d, t, *_ in rows]
    n_docs, n_all = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = Counter()
    for item, text in set(items):
        scores = []
        for doc, counts in docs:
            score = 0
            for t in set(terms(text)) & counts.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * (10 + 90 * sum(counts.values()) * n_docs // n_all)))
            if score > 0:
                scores.append((-score, math.inf if doc is None else doc))
        for rank, (score, doc) in enumerate(sorted(scores)[:top], 1):
            out[item, rank, None if doc == math.inf else doc, -score] += 1
    return out


def collection(seed):
    rnd = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(300)] + ["É", "ÑandÚ"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(80))), "en", "s") for i in range(400)]
    rows += [(9, rows[9][1], "en", "s")] * 5 + [(None, rows[10][1], "en", "s"), (600, None, None, None), (601, "t1 " * 40_000, "en", "s"), (602, "... !", "en", "s")]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 15)))) for i in range(25)]
    return rows, [*items, (3, "T299 t298; t0"), (50, None), (51, "nowhere"), (52, ""), items[0]]


@pytest.mark.parametrize("shard_docs", [1 << 12, 16])
def test_search_equals_brute_force(spark, documents, shard_docs, monkeypatch):
    rows, items = collection(1)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 600)  # several blocks
    monkeypatch.setattr(ranked_search, "index", lambda docs, f=ranked_search.index: f(docs, shard_docs))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = ranked_search.rank(documents(*rows), bench)
    assert Counter(tuple(r) for r in got.collect()) == searched(rows, items)


def test_search_of_nothing(spark, documents):
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    docs = documents((1, "a", "en", "s"))
    assert ranked_search.rank(docs, bench.limit(0)).collect() == []
    assert ranked_search.rank(docs.limit(0), bench).collect() == []
    assert [tuple(r)[:3] for r in ranked_search.rank(docs, bench).collect()] == [(1, 1, 1)]


def test_pair_bounds_read_less_and_lose_nothing():
    rnd, size = random.Random(2), 4000
    single = {}
    for t in range(8):
        docs = np.array(sorted(rnd.sample(range(size), 1200 - 100 * t)), np.int32)
        single[t] = docs, np.array([rnd.randrange(1, 100 * (t + 1)) for _ in docs], np.int64)
    joint = {}
    for a in range(7):
        found, at_a, at_b = np.intersect1d(single[a][0], single[a + 1][0], return_indices=True)
        apart = rnd.sample(range(len(found)), len(found) // 3)  # the two rarely stand together
        joint[a, a + 1] = found, single[a][1][at_a] + single[a + 1][1][at_b]
        single[a] = np.delete(single[a][0], at_a[apart]), np.delete(single[a][1], at_a[apart])
    total = np.zeros(size, np.int64)
    for docs, impact in single.values():
        total[docs] += impact
    for (a, b) in joint:  # impacts of what is left
        found, at_a, at_b = np.intersect1d(single[a][0], single[b][0], return_indices=True)
        joint[a, b] = found, single[a][1][at_a] + single[b][1][at_b]
    best = np.sort(total)[-10:]
    read = {}
    for pairs in (True, False):
        shard = ranked_search.Shard(size, single, joint, pairs)
        docs, scores, floor = shard.search(list(range(8)), int(best[0]), 10)
        assert (np.sort(scores)[-10:] == best).all() and floor <= best[0]
        read[pairs], bound = shard.read, shard.bounds(list(range(8)))
        assert bound[8] >= total.max()
    assert read[True] <= read[False] <= sum(len(d) for d, _ in single.values())
    apart = {0: (np.array([1, 2]), np.array([5, 9])), 1: (np.array([3]), np.array([7]))}
    pair = {(0, 1): (np.empty(0, np.int64), np.empty(0, np.int64))}
    assert ranked_search.Shard(9, apart, pair).bounds([0, 1]) == [0, 9, 9]
    assert ranked_search.Shard(9, apart, pair, use_pairs=False).bounds([0, 1]) == [0, 9, 16]
