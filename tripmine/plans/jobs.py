"""End-to-end jobs: from landed files to written results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmine.plans.gate import gate, newly_processed
from tripmine.plans.history import history
from tripmine.plans.tracker import track
from tripmine.sinks.flights import save_flights, save_tracked
from tripmine.sinks.seen import SeenIds, id_key
from tripmine.sinks.store import save_batch
from tripmine.sources.batches import latest_batch, load_emails
from tripmine.workspace import as_table


def history_job(
    spark: SparkSession,
    folder: str,
    target: str,
    year: int | None = None,
    file: str | None = None,
    latest_only: bool = False,
    **external,
) -> DataFrame:
    """Stored batches to a travel history in ``target``; returns its metadata.

    Reads a named batch, a year, the year's latest batch or everything. JSON
    is parsed once: the mails become a Parquet table, whose row count and text
    columns are then cheap to read. ``external`` are the tables of
    :func:`tripmine.plans.history.history`.
    """
    if latest_only and year is not None and file is None:
        file = latest_batch(spark, folder, year)
    mail = as_table(load_emails(spark, folder, year, file), "mail")
    return save_flights(history(mail, **external), target, mail.count(), year)


def gate_job(
    mail: DataFrame, store: str, batch_id: str, year: int, processed: DataFrame | SeenIds
) -> tuple[DataFrame | None, DataFrame]:
    """Gate fetched mail into the store as one batch.

    Returns the batch metadata, None if nothing passed, and the ids that are new. Ids
    remembered between runs (:class:`SeenIds`) are added to here; a table of processed ids
    is the caller's to append to.
    """
    metadata = save_batch(gate(mail, processed), store, batch_id, year)
    new = newly_processed(mail, processed)
    if isinstance(processed, SeenIds):
        new = as_table(new, "new_ids")
        processed.add(new.select(id_key("id")))
    return metadata, new


def tracker_job(messages: DataFrame, target: str) -> None:
    """Raw messages to tracked flights and their statistics in ``target``."""
    none = F.lit(None).cast("string")
    flights = track(messages).withColumns({"departure": none, "arrival": none})
    save_tracked(flights, target)
