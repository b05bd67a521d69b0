"""Quality rules: word statistics, two base limits and robust multivariate outliers.

For each language and source, centre and scatter of five transformed statistics are those of the three quarters
of the rows whose covariance has the smallest determinant (minimum covariance determinant). There are three
starts: medians with median deviations, the same with correlations of squashed values, and mean with covariance
of all rows. From each: measure Mahalanobis distances, take mean and covariance of the nearest three quarters of
each group, and repeat while the determinant of any group falls. The smallest determinant of a group wins. A document whose squared distance to its group is above the limit, the 0.999 quantile of
chi-square with five degrees of freedom, is rejected.

NULL texts count as empty: no words, so base_failed. Documents that fail the base rules take no part in
the estimates. A group of fewer than ``least`` rows is judged by the estimates of its whole language or, if that
is as small, of all rows, however few; so every row is judged. A NULL
language or source is a value of its own. Equal rows give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import BLANKS, staged, text_of, words_of
from tremorlake.operators.sizing import broadcast_when_small

WINDOW = 8
STATS = ("s_words", "s_length", "s_symbols", "s_lines", "s_repeat")
#: Smallest standard deviation that counts, in the units of each statistic.
FLOORS = (0.1, 0.1, 0.05, 0.1, 0.1)
NEAREST = 0.75
#: Makes the covariance of the nearest three quarters of a five-dimensional normal sample unbiased.
CONSISTENT = 1.41
#: Steps of one start at most, and the fall of a log determinant that still counts.
STEPS, FALL = 20, 1e-6
LIMIT = 20.515  # one of a thousand rows of a normal group lies beyond it
LEAST = 50


def _windows(words: Column) -> Column:
    """Hashes of all windows of eight words."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def _places(hashes: Column) -> Column:
    """(hash, start) of all windows, sorted, so that equal windows are neighbours."""
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _covered(places: Column) -> Column:
    """Number of words inside windows that occur more than once."""

    def twice(row: Column, at: Column) -> Column:
        before = (at > 0) & (F.get(places, at - 1)["h"] == row["h"])
        return before | F.coalesce(F.get(places, at + 1)["h"] == row["h"], F.lit(False))

    starts = F.array_sort(F.transform(F.filter(places, twice), lambda p: p["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct(
            (s["words"] + F.least(F.lit(WINDOW), i - s["last"])).alias("words"), i.alias("last")
        ),
        lambda s: s["words"],
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text, all within the row."""
    rows = docs.select("doc_id", "lang", "source", text_of().alias("__text"))
    rows = rows.withColumn("__words", words_of(F.col("__text")))
    rows = rows.withColumn("__hashes", _windows(F.col("__words")))
    # Only texts with a repeated window are searched for its places.
    again = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = rows.withColumn("__places", F.when(again, _places(F.col("__hashes")))).withColumn("__lines", lines)
    symbols = F.regexp_replace("__text", r"[^#*$%&|<>]+", "")
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("__words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.char_length(symbols).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("__lines").alias("n_lines"),
        F.when(F.col("__places").isNull(), F.lit(0)).otherwise(_covered(F.col("__places"))).cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _transformed(rows: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return rows.withColumns(
        {
            "s_words": F.log1p("n_words"),
            "s_length": F.col("word_chars") / words,
            "s_symbols": F.sqrt(F.col("n_symbols") / words),
            "s_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            "s_repeat": F.sqrt(F.col("n_repeat_words") / words),
        }
    )


def _factored(groups: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the covariances c_i_j, one step at a time, and log_det from its diagonal."""
    size = len(STATS)
    for j in range(size):
        earlier = [F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]
        pivot = F.col(f"c_{j}_{j}") - sum(earlier, F.lit(0.0))
        groups = groups.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(pivot, F.lit(1e-6))))
        for i in range(j + 1, size):
            cross = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            groups = groups.withColumn(f"l_{i}_{j}", (F.col(f"c_{i}_{j}") - cross) / F.col(f"l_{j}_{j}"))
    return groups.withColumn("log_det", sum((2 * F.log(f"l_{j}_{j}") for j in range(size)), F.lit(0.0)))


def _beside(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with their group's values; one row per group is mostly small enough to be broadcast."""
    return rows.join(groups.withColumnRenamed("gid", "__gid"), F.col("gid") == F.col("__gid"))


def _distance(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance ``d2`` to their group's centre."""
    keep = [c for c in rows.columns if c != "d2"]
    joined = _beside(rows.drop("d2"), groups)
    for i, name in enumerate(STATS):
        done = sum((F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)), F.lit(0.0))
        joined = joined.withColumn(f"z_{i}", (F.col(name) - F.col(f"m_{i}") - done) / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(STATS))), F.lit(0.0))
    return joined.select(*keep, total.alias("d2"))


def _moments(names: list[str]) -> list[Column]:
    """Aggregates m_i and r_i_j: means and covariances."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    means = [F.avg(s).alias(f"m_{i}") for i, s in enumerate(names)]
    return means + [F.covar_pop(names[i], names[j]).alias(f"r_{i}_{j}") for i, j in pairs]


def _scattered(groups: DataFrame, factor: float) -> DataFrame:
    """r_i_j times ``factor``, widened by the floors, with their Cholesky factor."""
    size = len(STATS)
    for i in range(size):
        for j in range(i + 1):
            value = F.col(f"r_{i}_{j}") * factor
            groups = groups.withColumn(f"c_{i}_{j}", value + FLOORS[i] ** 2 if i == j else value)
    groups = groups.drop(*(f"r_{i}_{j}" for i in range(size) for j in range(i + 1)))
    return broadcast_when_small(staged(_factored(groups), "scatter"), max_bytes=16 << 20)


def _starts(rows: DataFrame) -> list[DataFrame]:
    """First centres and scatters of every group, in three ways; all follow from the rows alone."""
    size = len(STATS)
    middle = rows.groupBy("gid").agg(*(F.percentile_approx(s, 0.5, 10000).alias(f"m_{i}") for i, s in enumerate(STATS)))
    middle = broadcast_when_small(staged(middle, "medians"), max_bytes=16 << 20)
    spread = _beside(rows, middle).groupBy("gid").agg(
        *(F.percentile_approx(F.abs(F.col(s) - F.col(f"m_{i}")), 0.5, 10000).alias(f"d_{i}") for i, s in enumerate(STATS))
    )
    deviations = [F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(FLOORS[i])).alias(f"d_{i}") for i in range(size)]
    middle = staged(middle.join(spread, "gid").select("gid", *(f"m_{i}" for i in range(size)), *deviations), "spread")
    # Squashed values bound what one far row can do to a correlation.
    squashed = _beside(rows, middle).select(
        "gid", *(F.tanh((F.col(s) - F.col(f"m_{i}")) / F.col(f"d_{i}")).alias(f"t_{i}") for i, s in enumerate(STATS))
    )
    wound = squashed.groupBy("gid").agg(*_moments([f"t_{i}" for i in range(size)])).drop(*(f"m_{i}" for i in range(size)))
    alone, tied = middle, middle.join(wound, "gid")
    for i in range(size):
        for j in range(i + 1):
            product = F.col(f"d_{i}") * F.col(f"d_{j}")
            norm = F.sqrt(F.col(f"r_{i}_{i}") * F.col(f"r_{j}_{j}"))
            share = F.when(norm > 0, F.col(f"r_{i}_{j}") / norm).otherwise(0.0)
            alone = alone.withColumn(f"r_{i}_{j}", product if i == j else F.lit(0.0))
            # The diagonal is kept for last, as the shares are taken from it.
            tied = tied.withColumn(f"q_{i}_{j}", product if i == j else share * product)
    places = [(i, j) for i in range(size) for j in range(i + 1)]
    tied = tied.select("gid", *(f"m_{i}" for i in range(size)), *(F.col(f"q_{i}_{j}").alias(f"r_{i}_{j}") for i, j in places))
    alone = alone.drop(*(f"d_{i}" for i in range(size)))
    plain = rows.groupBy("gid").agg(*_moments(list(STATS)))
    return [_scattered(start, 1.0) for start in (alone, tied, plain)]


def _concentrate(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One concentration step: mean and covariance of the rows nearest to the present centres."""
    measured = _distance(rows, groups)
    edge = measured.groupBy("gid").agg(F.percentile_approx("d2", NEAREST, 10000).alias("edge"))
    near = _beside(measured, edge).where("d2 <= edge")
    return _scattered(near.groupBy("gid").agg(*_moments(list(STATS))), CONSISTENT)


def _smaller(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of both estimates of each group the one with the smaller determinant, the old one if equal, and the fall."""
    names = [c for c in old.columns if c not in ("gid", "fall")]
    rows = old.select("gid", *names, F.lit(0).alias("at")).unionByName(new.select("gid", *names, F.lit(1).alias("at")))
    order = F.struct("log_det", "at", *(c for c in names if c != "log_det"))
    found = rows.groupBy("gid").agg(F.min(order).alias("best"), (F.max("log_det") - F.min("log_det")).alias("apart"))
    fall = F.when(F.col("best.at") == 1, F.col("apart")).otherwise(0.0)
    return staged(found.select("gid", "best.*", fall.alias("fall")).drop("at"), "scatter")


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """One row per gid: centre m_i, covariance c_i_j, its Cholesky factor l_i_j and log_det.

    The starts go their way side by side: a row stands once in each, with numbers only. A step that does not lower a
    group's determinant leaves the group as it was, so all of them end.
    """
    starts = _starts(rows)
    copies = F.explode(F.array(*map(F.lit, range(len(starts))))).alias("start")
    mark = F.xxhash64("gid", "start")
    each = staged(rows.select("gid", *STATS, copies).select(mark.alias("gid"), *STATS), "starts")
    now = None
    for i, start in enumerate(starts):
        named = start.withColumn("start", F.lit(i)).withColumn("gid", mark).drop("start")
        now = named if now is None else now.unionByName(named)
    now = _concentrate(each, broadcast_when_small(staged(now, "first"), max_bytes=16 << 20))  # the starts' own scatters are not of three quarters
    for _ in range(steps - 1):
        now = broadcast_when_small(_smaller(now, _concentrate(each, now)), max_bytes=16 << 20)
        if now.where(F.col("fall") > FALL).isEmpty():
            break
    owners = starts[0].select("gid", copies).select(F.col("gid").alias("own"), "start", mark.alias("of"))
    names = [c for c in now.columns if c not in ("gid", "fall", "log_det")]
    ends = now.join(owners, F.col("gid") == F.col("of")).groupBy("own").agg(F.min(F.struct("log_det", "start", *names)).alias("best"))
    return staged(ends.select(F.col("own").alias("gid"), "best.*").drop("start"), "estimates")


def judge(docs: DataFrame, steps: int = STEPS, limit: float = LIMIT, least: int = LEAST) -> DataFrame:
    """Statistics, base_failed, distance (squared, NULL if none) and kept for every document.

    The texts are read once; the statistics are written and read back. Groups meet their estimates in
    broadcast joins, so a language and source that holds a third of all rows stays where its rows are.
    """
    def key(*names: str) -> Column:
        return F.xxhash64(*(x for c in map(F.col, names) for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))))

    keyed = _transformed(statistics(docs)).withColumns({"__own": key("lang", "source"), "__lang": key("lang")})
    rows = staged(keyed, "statistics")
    sound = rows.where("not base_failed")
    sizes = staged(sound.groupBy("__own", "__lang").count(), "sizes")
    langs = sizes.groupBy(F.col("__lang").alias("__l")).agg(F.sum("count").alias("in_lang"))
    chosen = F.when(F.col("count") >= least, F.col("__own")).when(F.col("in_lang") >= least, F.col("__lang")).otherwise(0)
    sizes = staged(sizes.join(langs, F.col("__lang") == F.col("__l")).select("__own", "__lang", chosen.alias("chosen")), "chosen")
    # A group gives its rows to its own estimates and to those that stand in for small groups of its language or of all.
    stand_in = sizes.where("chosen <> __own").select(F.col("chosen").alias("gid")).distinct()
    given = sizes.select("__own", "chosen", F.explode(F.array_distinct(F.array("__own", "__lang", F.lit(0)))).alias("gid"))
    given = given.join(stand_in.withColumnRenamed("gid", "__in"), F.col("gid") == F.col("__in"), "left")
    given = given.where("gid = chosen or __in is not null").select(F.col("__own").alias("__of"), "gid", (F.col("gid") == F.col("chosen")).alias("judged"))
    sound = staged(sound.join(given, F.col("__own") == F.col("__of")).drop("__own", "__of", "__lang"), "grouped")
    groups = broadcast_when_small(estimates(sound, steps), max_bytes=16 << 20)
    measured = _distance(sound.where("judged"), groups)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = measured.select(*columns, (F.col("d2") <= limit).alias("kept"), F.col("d2").alias("distance"))
    failed = rows.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return good.union(failed)
