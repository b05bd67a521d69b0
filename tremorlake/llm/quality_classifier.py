"""Quality classifier by co-training of two views.

One view is the text's content (hashed character trigrams of the whole text), the other the page's
metadata (language, source, size and layout). Each view has a logistic regression. In each round the
views, calibrated, score all documents without a label, and each lends the other one those it is surest of, in the
labels' proportion of classes; lent rows weigh less than real ones. A view keeps what it learnt from them
only if its loss on held-out labels falls by more than the standard error of the change. In the end the calibrated log-odds add up, less the prior, and
the sum is calibrated once more to the score of every document.

Training uses about ``labelled`` labelled documents, chosen by hash (the only sample), a fifth of them held out.
A view lends at most 2 * ``lend`` documents in a round, ties by hash. All documents are scored. NULL texts count as empty, NULL language
and source are values of their own. Labels that are NULL are left out, several labels of one id count
by their mean. Without labels of both classes nothing is learnt: scores are NULL, all are accepted.
Equal rows get equal scores. Columns named p_text, p_page, score and accepted are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake.llm.common import ship, staged, text_of
from tremorlake.operators.sizing import broadcast_when_small

LABELLED = 6000
LEND = 500
ROUNDS = 3
SURE = 0.95
#: Weight of a lent row against a labelled one.
LENT = 0.3
ACCEPT = 0.5
TEXT_SIZE = 512
_LANGS, _SOURCES = 16, 64
PAGE_SIZE = _LANGS + _SOURCES + 8
_OUT = ("p_text", "p_page", "score", "accepted")


def text_features(text: str) -> np.ndarray:
    """Square roots of trigram shares by hash, two shares of repeats, and 1 for the intercept.

    All shares are of a size some units larger, so a few characters are weak evidence.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(TEXT_SIZE + 3, np.float32)
    out[-1] = 1
    if len(codes) > 2:
        mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
        counts = np.bincount((mixed * np.uint32(0x27D4EB2F) >> np.uint32(23)).astype(np.int64), minlength=TEXT_SIZE)
        out[:TEXT_SIZE] = np.sqrt(counts / (counts.sum() + 50)) * 4
        words = text.split()
        out[-3] = 8 * sum(map(eq, words, words[1:])) / (len(words) + 5)
        out[-2] = 2 * (1 - len(set(words)) / len(words)) if words else 0
    return out


def page_features(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Hashed language and source, logarithms of sizes, shares of kinds of characters, and 1."""
    out = np.zeros(PAGE_SIZE + 1, np.float32)
    out[-1] = 1
    for value, start, size in ((lang, 0, _LANGS), (source, _LANGS, _SOURCES)):
        out[start + xxhash.xxh32_intdigest(repr(value)) % size] = 1
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 32) | (codes >= 9) & (codes <= 13)
    upper = (codes >= 65) & (codes <= 90)
    digit = (codes >= 48) & (codes <= 57)
    marks = (codes > 32) & (codes < 127) & ~upper & ~digit & ~((codes >= 97) & (codes <= 122))
    lines = 1 + int((codes == 10).sum())
    words = 1 + int((blank[1:] & ~blank[:-1]).sum())
    size = len(codes) + 50
    at = _LANGS + _SOURCES
    out[at : at + 8] = (
        np.log1p(len(codes)) / 10,
        np.log1p(lines) / 5,
        np.log1p(size / lines) / 5,
        np.log1p(size / (words + 10)),
        4 * upper.sum() / size,
        4 * digit.sum() / size,
        8 * marks.sum() / size,
        4 * blank.sum() / size,
    )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 8, counts: np.ndarray | float = 1.0) -> np.ndarray:
    """Logistic regression of rows that weigh ``counts``, by Newton steps with a ridge on all weights but the last."""
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ weights)
        curve = (x * (counts * (p * (1 - p) + 1e-6))[:, None]).T @ x
        curve[np.diag_indices_from(curve)] += penalty
        step = np.linalg.solve(curve, x.T @ (counts * (y - p)) - penalty * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    return weights


@dataclass(frozen=True)
class Model:
    text: np.ndarray
    page: np.ndarray
    text_scale: tuple[float, float]
    page_scale: tuple[float, float]
    prior: float
    sum_scale: tuple[float, float] = (1.0, 0.0)

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one = self.text_scale[0] * (text @ self.text) + self.text_scale[1]
        two = self.page_scale[0] * (page @ self.page) + self.page_scale[1]
        return _sigmoid(one), _sigmoid(two), _sigmoid(self.sum_scale[0] * (one + two - self.prior) + self.sum_scale[1])


def _calibrated(raw: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], np.ndarray]:
    """Slope and intercept that turn raw scores into log-odds, and the log loss they leave on each row."""
    a, b = fit(np.c_[raw, np.ones(len(raw))], y, ridge=1e-2)
    scale = (float(max(a, 0.0)), float(b))
    p = np.clip(_sigmoid(scale[0] * raw + scale[1]), 1e-9, 1 - 1e-9)
    return scale, -(y * np.log(p) + (1 - y) * np.log(1 - p))


#: What each view lends the other: its features of both views, and the labels.
Loan = tuple[np.ndarray, np.ndarray, np.ndarray]


def co_train(
    text: np.ndarray, page: np.ndarray, y: np.ndarray, exchange: Callable[[Model], Sequence[Loan]], rounds: int = ROUNDS
) -> Model | None:
    """The model after ``rounds`` rounds; ``exchange`` gives what the text view and what the page view lend."""
    if len(np.unique(y)) < 2:
        return None
    fifth = np.arange(len(y)) % 5 == 0
    held, taught = np.flatnonzero(fifth), np.flatnonzero(~fifth)
    if len(np.unique(y[held])) < 2 or len(np.unique(y[taught])) < 2:
        held = taught = np.arange(len(y))
    views, known, real = (text.astype(np.float64), page.astype(np.float64)), y[taught].astype(np.float64), y[held].astype(np.float64)
    prior = float(np.log(real.mean() / (1 - real.mean())))
    weights = [fit(view[taught], known) for view in views]
    scales, losses = zip(*(_calibrated(view[held] @ w, real) for view, w in zip(views, weights)))
    scales, losses = list(scales), list(losses)
    for _ in range(rounds - 1):
        loans, learnt = exchange(Model(*weights, *scales, prior)), False
        for v in (0, 1):
            lent, marks = loans[1 - v][v], loans[1 - v][2]
            if not len(marks):
                continue
            counts = np.r_[np.ones(len(known)), np.full(len(marks), LENT)]
            tried = fit(np.r_[views[v][taught], lent], np.r_[known, marks], counts=counts)
            scale, loss = _calibrated(views[v][held] @ tried, real)
            change = loss - losses[v]
            if change.mean() < -change.std() / np.sqrt(len(change)):
                weights[v], scales[v], losses[v], learnt = tried, scale, loss, True
        if not learnt:
            break
    model = Model(*weights, *scales, prior)
    one, two = (a * (view[held] @ w) + b for view, w, (a, b) in zip(views, weights, scales))
    return replace(model, sum_scale=_calibrated(one + two - prior, real)[0])


def _views(docs: DataFrame) -> DataFrame:
    """The features of (text, lang, source) and the other columns as they are."""
    rest = docs.schema.fields[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            arrays = [
                pa.array([text_features(t).tobytes() for t, *_ in rows], pa.binary()),
                pa.array([page_features(*r).tobytes() for r in rows], pa.binary()),
                *batch.columns[3:],
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["text", "page", *(f.name for f in rest)])

    return docs.mapInArrow(run, T.StructType([T.StructField("text", T.BinaryType()), T.StructField("page", T.BinaryType()), *rest]))


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of both views and y; the order in which rows arrive must not matter."""
    size = {"text": TEXT_SIZE + 3, "page": PAGE_SIZE + 1}
    views = {n: np.frombuffer(b"".join(table[n].to_pylist()), np.float32).reshape(-1, s) for n, s in size.items()}
    y = table["y"].to_numpy()
    by = np.lexsort((views["page"][:, -2], views["text"].sum(axis=1), y))
    return views["text"][by], views["page"][by], y[by]


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """p_text and p_page of (text, lang, source), and the other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.schema.fields[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(shared.value, *(batch.column(i).to_pylist() for i in range(3)))
            arrays = [*(pa.array(s, pa.float64()) for s in scores[:2]), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(arrays, ["p_text", "p_page", *(f.name for f in rest)])

    return docs.mapInArrow(run, T.StructType([T.StructField(n, T.DoubleType()) for n in _OUT[:2]] + rest))


def _scores(model: Model, *columns: list) -> list[np.ndarray]:
    rows, parts = list(zip(*columns)), []
    for start in range(0, len(rows), 1024):
        some = [(t or "", lang, source) for t, lang, source in rows[start : start + 1024]]
        parts.append(model.score(np.stack([text_features(t) for t, *_ in some]), np.stack([page_features(*r) for r in some])))
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0)] * 3


def _exchange(docs: DataFrame, marks: DataFrame, model: Model, lend: int, sure: float) -> list[Loan]:
    """What each view lends: chosen among all documents without a label, of which only scores are written."""
    rows = docs.select(*_inputs(), "doc_id", F.xxhash64("doc_id", text_of()).alias("key"))
    free = _scored(rows, model).where(F.greatest(*(F.greatest(F.col(c), 1 - F.col(c)) for c in _OUT[:2])) >= sure)
    labelled = broadcast_when_small(staged(marks.select("__id"), "labelled"), max_bytes=16 << 20)
    free = staged(free.join(labelled, F.col("doc_id") == F.col("__id"), "left_anti").drop("doc_id"), "sure")
    share, picks = 1 / (1 + np.exp(-model.prior)), []
    for v, name in enumerate(_OUT[:2]):
        for y, p, part in ((0, 1 - F.col(name), 1 - share), (1, F.col(name), share)):
            best = free.where(p >= sure).orderBy(p.desc(), "key").limit(round(2 * lend * part))
            picks.append(best.select(F.col("key").alias("__key"), F.lit(v).alias("v"), F.lit(y).alias("y")))
    chosen = staged(reduce(DataFrame.union, picks).distinct(), "lent")
    met = docs.join(F.broadcast(chosen), F.xxhash64("doc_id", text_of()) == F.col("__key"))  # 4 * lend rows at most
    table = _views(met.select(*_inputs(), "__key", "v", "y")).dropDuplicates(["__key", "v"]).toArrow()
    return [_arrays(table.filter(pc.equal(table["v"], v))) for v in (0, 1)]


def _inputs() -> list[Column]:
    return [text_of().alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]


def _share(wanted: int, there: int) -> int:
    """Rows whose hash is below this are about ``wanted`` of ``there``."""
    return -(1 << 63) + min((1 << 64) - 1, (1 << 64) * wanted // max(1, there))


def train(
    docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, lend: int = LEND, rounds: int = ROUNDS, sure: float = SURE
) -> Model | None:
    """The model of both views; the driver gets the features of the labelled sample and of the lent documents."""
    ship(docs.sparkSession)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    marks = marks.select(F.col("doc_id").alias("__id"), (F.col("q") >= 0.5).cast("int").alias("y"))
    picked = marks.where(F.xxhash64("__id") < _share(labelled, marks.count()))
    known = docs.join(picked, F.col("doc_id") == F.col("__id"))
    known = known.where(F.xxhash64("doc_id", text_of()) < _share(labelled, known.select("doc_id", "y").count()))
    table = _views(known.select(*_inputs(), "y")).toArrow()
    if not table.num_rows:
        return None
    return co_train(*_arrays(table), lambda model: _exchange(docs, marks, model, lend, sure), rounds)


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **bounds) -> DataFrame:
    """``docs`` with p_text, p_page, score (probability of good quality) and accepted."""
    kept = docs.select(*(c for c in docs.columns if c not in _OUT))
    model = train(kept, labels, **bounds)
    if model is None:
        none = F.lit(None).cast("double")
        return kept.select("*", none.alias("p_text"), none.alias("p_page"), none.alias("score"), F.lit(True).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = kept.columns
    at = [names.index(c) for c in ("text", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(shared.value, *(batch.column(i).to_pylist() for i in at))
            arrays = [*batch.columns, *(pa.array(s, pa.float64()) for s in scores), pa.array(scores[2] >= accept)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *_OUT])

    fields = [T.StructField(n, T.DoubleType()) for n in _OUT[:3]] + [T.StructField("accepted", T.BooleanType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))
