"""Report files from stored tracker results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripmine.sinks.flights import save_csv, save_listing
from tripmine.sources.results import latest_results, load_results


def latest_flights(spark: SparkSession, folder: str) -> DataFrame:
    return load_results(spark, latest_results(spark, folder))


def write_report(flights: DataFrame, target: str) -> dict[str, str]:
    """Write listing and CSV of a flight table; returns where they are."""
    paths = {"listing": f"{target}/listing", "csv": f"{target}/csv"}
    save_listing(flights, paths["listing"])
    save_csv(flights, paths["csv"])
    return paths
