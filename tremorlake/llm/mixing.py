"""Mixing sources to target weights by a time-varying curriculum.

Sources in code-point order (NULL last) weigh 5, 2, 1, repeating. They share 150 % of all words by
weight; a target stops at twice its source's words and the excess is shared again. Over training time
u in [0, 1] a source's weight follows a piecewise linear schedule. Its integral, scaled to the target,
is the source's cumulative demand. A source's documents, in a fixed shuffled order and repeated as
needed, fill that demand one after the other: the words before a document, put through the inverse of
the demand, are its position. Documents of all sources are then range-sorted by position.

A document at the end of a source's demand gives only its first words; all others are taken whole.
NULL or blank texts have size 0 and are never taken. Rows with equal or NULL ids count one by one. A
NULL source is a source of its own. The shuffled order is that of md5(doc_id), so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import running_total, staged, text_of, words_of
from tremorlake.operators.sizing import broadcast_when_small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Weights of a source at equally spaced times, one schedule for each weight class.
SCHEDULES = ((1.0, 0.5, 0.25), (0.5, 1.0, 1.0), (0.25, 0.5, 1.0))


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def _cycle(index: Column, values: Sequence) -> Column:
    chosen = F.lit(values[-1])
    for i, value in reversed(list(enumerate(values[:-1]))):
        chosen = F.when(index % len(values) == i, F.lit(value)).otherwise(chosen)
    return chosen


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with ``index``, ``weight`` and ``target``.

    The common level (words per weight) rises until no target is above its limit: each round counts the
    limited sources in and shares the rest among the others. Only the level travels to the driver.
    """
    ranked = running_total(sources, [], [F.col("source")], F.lit(1), "index")
    ranked = staged(ranked.withColumn("weight", _cycle(F.col("index"), weights)), "sources")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        above = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        full, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(above, F.col("source_size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        risen = (total - full) / open_weight if open_weight else level
        if risen <= level:
            break
        level = risen
    limit = (F.col("source_size") * most).cast("double")
    return ranked.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def _position(demand: Column, schedule: Sequence[float]) -> Column:
    """The time at which the integral of a piecewise linear schedule is the share ``demand`` of it all."""
    step = 1.0 / (len(schedule) - 1)
    areas = [step * (a + b) / 2 for a, b in zip(schedule, schedule[1:])]
    want = demand * sum(areas)
    before, found = 0.0, F.lit(1.0)
    pieces = []
    for i, (a, b) in enumerate(zip(schedule, schedule[1:])):
        rest = F.greatest(want - before, F.lit(0.0))
        # a*x + (b-a)*x*x/(2*step) = rest, solved for x without cancellation
        slope = (b - a) / step
        x = 2 * rest / (a + F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0))))
        pieces.append((before + areas[i], i * step + F.least(x, F.lit(step))))
        before += areas[i]
    for end, value in reversed(pieces):
        found = F.when(want <= end, value).otherwise(found)
    return found


def mix(docs: DataFrame, keep: Sequence[str] | None = None, schedules: Sequence[Sequence[float]] = SCHEDULES, **rules) -> DataFrame:
    """``docs`` with size, source_size, target, taken, takes (words of each pass) and positions.

    ``docs`` needs doc_id, source and text. Its columns, or those in ``keep`` (doc_id and source among
    them), stay, but columns of the names above are replaced.
    """
    new = ("size", "source_size", "target", "taken", "takes", "positions")
    kept = [c for c in keep or docs.columns if c not in new]
    sized = docs.select(*kept, size_of(text_of()).alias("size"))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **rules)
    shuffled = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("size")]
    placed = running_total(sized, [F.col("source")], shuffled, F.col("size"), "__before")
    sources = sources.select(F.col("source").alias("__source"), "source_size", "target", "index")
    placed = placed.join(sources, F.col("source").eqNullSafe(F.col("__source")))
    wanted = F.floor("target")
    passes = [F.col("__before") + F.col("source_size") * k for k in range(rules.get("most", MOST))]
    takes = [F.greatest(F.least(wanted - start, F.col("size")), F.lit(0)).cast("bigint") for start in passes]
    kinds = len(schedules)
    positions = []
    for start, take in zip(passes, takes):
        share = (start + take / 2) / F.greatest(wanted, F.lit(1))
        at = _position(share, schedules[-1])
        for i in range(kinds - 1):
            at = F.when(F.col("index") % kinds == i, _position(share, schedules[i])).otherwise(at)
        positions.append(F.when(take > 0, at))
    return placed.select(
        *kept, "size", "source_size", "target", sum(takes[1:], takes[0]).alias("taken"),
        F.array(*takes).alias("takes"), F.array(*positions).alias("positions"),
    )


def _passes(mixed: DataFrame) -> DataFrame:
    """One row for each pass that takes a document, with ``take`` and ``position``."""
    passes = F.explode(F.arrays_zip(F.col("takes").alias("take"), F.col("positions").alias("position")))
    rows = mixed.select(*(c for c in mixed.columns if c not in ("takes", "positions", "take", "position")), passes.alias("__pass"))
    return rows.where("__pass.take > 0").select("*", "__pass.take", "__pass.position").drop("__pass")


def training_order(docs: DataFrame, **rules) -> DataFrame:
    """``docs`` once for each pass that takes a document, with size, take and position, sorted by position.

    The documents are written once with a row number. Only ids, sources and sizes go through the running
    totals; the texts meet their passes at the end, without a shuffle while the passes measure small, and
    are range-sorted. Columns named size, take and position are replaced.
    """
    wide = staged(docs.drop("size", "take", "position").withColumn("__row", F.monotonically_increasing_id()), "documents")
    passes = _passes(mix(wide, keep=("doc_id", "source", "__row"), **rules))
    passes = staged(passes.select(F.col("__row").alias("__of"), "size", "take", "position"), "passes")
    passes = broadcast_when_small(passes, max_bytes=32 << 20)
    return wide.join(passes, F.col("__row") == F.col("__of")).drop("__row", "__of").orderBy("position", "doc_id")
