"""Raw feeds to the clean event table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tremorlake.operators.dedup import dedup_both
from tremorlake.operators.normalize import SOURCE_PRIORITY, FeedLayout, normalize_feed, union_feeds
from tremorlake.schemas import UNIFIED_COLUMNS
from tremorlake.sources.readers import register_partitions, scan_feed
from tremorlake.sources.writers import write_table


def clean_events(
    feeds: Sequence[tuple[DataFrame, FeedLayout]],
    priority: Sequence[str] = SOURCE_PRIORITY,
    null_keys: str = "keep",
) -> DataFrame:
    """Normalise, unite and de-duplicate raw feeds."""
    unified = union_feeds([normalize_feed(feed, layout) for feed, layout in feeds])
    return dedup_both(unified, priority, null_keys).select(*UNIFIED_COLUMNS)


def run_clean(
    spark: SparkSession,
    feeds: Mapping[str, FeedLayout],
    table: str = "earthquake_clean",
    path: str | None = None,
    raw_tables: Sequence[str] = (),
    null_keys: str = "keep",
    overwrite: str = "full",
) -> None:
    """``feeds`` maps feed directories to their layouts; the result is partitioned by ``dt``."""
    register_partitions(spark, *raw_tables)
    raw = [(scan_feed(spark, directory), layout) for directory, layout in feeds.items()]
    write_table(clean_events(raw, null_keys=null_keys), table, ["dt"], path, overwrite)
