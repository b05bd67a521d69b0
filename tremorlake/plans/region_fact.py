"""Clean events and region boxes to the region daily fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremorlake.operators.daily_stats import daily_stats
from tremorlake.operators.regions import BoxPlan, locate
from tremorlake.schemas import REGION_FACT_COLUMNS
from tremorlake.sources.readers import read_regions, scan_table
from tremorlake.sources.writers import write_table

BIGGEST = {"max_mag_event_id": "id", "max_mag_event_place": "place"}


def region_daily_fact(events: DataFrame, regions: DataFrame, plan: BoxPlan | None = None) -> DataFrame:
    boxes = regions.select("region_id", "lat_min", "lat_max", "lon_min", "lon_max")
    located = locate(events, boxes, "inner", plan)
    return daily_stats(located, "region_id", BIGGEST).select(*REGION_FACT_COLUMNS)


def run_region_fact(
    spark: SparkSession,
    regions_csv: str,
    source: str = "earthquake_clean",
    table: str = "fact_region_daily_stats",
    overwrite: str = "full",
) -> None:
    fact = region_daily_fact(scan_table(spark, source), read_regions(spark, regions_csv))
    write_table(fact, table, ["dt"], overwrite=overwrite)
