"""Helpers that several operators share: texts, words, staged tables, running totals, components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tremorlake.sources.writers import Scratch, Staged

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

_STAGED: list[Scratch] = []
_SCOPES = threading.local()  # a thread's open scopes of ``passing``, the innermost last


def text_of(name: str = "text") -> Column:
    """The text of a row; a NULL text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for a text without words."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def staged(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """``df`` written once below the shared scratch folder and read back; lineage ends there."""
    kept = Staged(df, label, codec)
    _STAGED.append(kept)
    if open_ := getattr(_SCOPES, "open", None):
        open_[-1].append(kept)
    return kept.df


@contextlib.contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged in the block are deleted when it ends, but those given to the function that it hands out.

    These pass to the block around. Where the block fails, ``release`` deletes them.
    """
    scopes = _SCOPES.__dict__.setdefault("open", [])
    scopes.append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    except BaseException:
        scopes.pop()
        raise
    for table in scopes.pop():
        if any(table.df is df for df in kept):
            if scopes:
                scopes[-1].append(table)
        else:
            table.drop()
            if table in _STAGED:
                _STAGED.remove(table)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared scratch folder, deleted by ``release``."""
    kept = Scratch(spark, label)
    _STAGED.append(kept)
    return kept.path


def release() -> None:
    """Delete every staged table and scratch path of this process. Results that still read one must be written first."""
    while _STAGED:
        with contextlib.suppress(Exception):  # the session may be gone
            _STAGED.pop().drop()


atexit.register(release)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; a cluster need not have it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as folder:  # the driver's; Spark copies the archive at once
        archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
        kept = tempfile.NamedTemporaryFile(suffix=".zip", prefix=f"{package.name}-")
        shutil.copy(archive, kept.name)
    _ARCHIVES.append(kept)  # served to workers until the process ends
    context.addPyFile(kept.name)


_ARCHIVES: list = []


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(
    df: DataFrame, groups: Sequence[Column], order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each row of its group.

    The rows are dealt by range over (groups, order), so a hot group spreads over many tasks. Each
    slice is summed on its own; the slices' totals, one row per slice and group, are summed once more
    and added. Equal order keys stand in any order. ``__part`` and ``__g*`` are working names.
    """
    keys = [f"__g{i}" for i in range(len(groups))]
    sorts = [f"__o{i}" for i in range(len(order))]
    work = df.select(
        "*",
        *(g.alias(k) for g, k in zip(groups, keys)),
        *(o.alias(k) for o, k in zip(order, sorts)),
        value.cast("bigint").alias("__value"),
    )
    by = [F.asc_nulls_last(k) for k in (*keys, *sorts)]
    dealt = work.repartitionByRange(partitions(df.sparkSession), *by)
    dealt = staged(dealt.withColumn("__part", F.spark_partition_id()), "slices")
    inside = Window.partitionBy("__part", *keys).orderBy(*(F.asc_nulls_last(k) for k in sorts))
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    slices = dealt.groupBy("__part", *keys).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        F.col("__part").alias("__p"),
        *(F.col(k).alias(f"{k}s") for k in keys),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"),
    )
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}s"))
    summed = dealt.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return summed.join(slices, same).select(
        *df.columns, (F.col("__inside") + F.col("__before")).alias(name)
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the smallest node.

    Alternating large and small stars: each step links every node to the smallest neighbour it knows.
    Each round is written and read back. A hub is a hot key of a join, which adaptive execution splits.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = None
    while True:
        with passing() as keep:
            both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(
                F.col("a").alias("u"), F.least("a", "m").alias("m")
            )
            large = both.where("b > a").join(lowest, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = staged(large.where("a <> b").distinct(), "edges")
            lowest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
            small = large.join(lowest, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            small = small.where("a <> b").union(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
            now = keep(staged(small.distinct(), "edges"))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
