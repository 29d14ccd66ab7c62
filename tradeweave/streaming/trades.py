"""Keeping trade edges current as payment files arrive (ST1).

Each micro-batch writes its own totals to ``batches/batch_id=<n>``, replacing whatever an
interrupted attempt left there, so a replay never counts a payment twice and a
batch costs no more than its own payments.  Readers add the batches up.  From time to time the batches
so far are folded into ``bases/<n>``: readers take the newest base and the batches after its n.
A base appears by one rename, so a reader sees it whole or not at all while the stream runs on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradeweave.operators.edges import elapsed_interval, trade_totals
from tradeweave.schema import MONEY_SUM
from tradeweave.session import TABLE_CODEC, delete_folder, folder_names, make_folder, rename_folder


def stream_trades(
    transactions: DataFrame,
    accounts: DataFrame,
    totals_path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream; ``transactions`` comes from readStream."""

    def store(batch: DataFrame, batch_id: int) -> None:
        trade_totals(batch, accounts).write.mode("overwrite").parquet(f"{totals_path}/batches/batch_id={batch_id}", compression=TABLE_CODEC)

    writer = transactions.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _bases(spark: SparkSession, totals_path: str) -> list[int]:
    return sorted(map(int, folder_names(spark, f"{totals_path}/bases") or []))


def _batches(spark: SparkSession, totals_path: str, after: int) -> list[int]:
    """Numbers of the batches that are written completely."""
    names = folder_names(spark, f"{totals_path}/batches") or []
    numbers = sorted(n for n in (int(x.partition("=")[2]) for x in names if x.startswith("batch_id=")) if n > after)
    return [n for n in numbers if "_SUCCESS" in (folder_names(spark, f"{totals_path}/batches/batch_id={n}") or [])]


def merged_totals(spark: SparkSession, totals_path: str, upto: int | None = None) -> DataFrame:
    """Totals per edge over all batches, or those up to a number; first and last date keep the interval derivable."""
    bases = [n for n in _bases(spark, totals_path) if upto is None or n <= upto]
    after = bases[-1] if bases else -1
    paths = [f"{totals_path}/bases/{after}"] if bases else []
    paths += [f"{totals_path}/batches/batch_id={n}" for n in _batches(spark, totals_path, after) if upto is None or n <= upto]
    return (
        spark.read.parquet(*paths)
        .groupBy("src", "dst")
        .agg(
            F.sum("amount").cast(MONEY_SUM).alias("amount"),
            F.sum("tx_count").alias("tx_count"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
        )
    )


def current_trades(spark: SparkSession, totals_path: str) -> DataFrame:
    return merged_totals(spark, totals_path).select(
        "src", "dst", "amount", "tx_count", elapsed_interval().alias("avg_interval")
    )


def compact(spark: SparkSession, totals_path: str, upto: int | None = None) -> int | None:
    """Fold the batches up to a number (by default all that are complete) into one base; returns its number, or None if there is nothing new.

    Batches are folded as far as none is missing.  A batch that is replayed later is written again and ignored, since the base holds the same payments.  What the
    base before this one replaced is deleted now, and what this one replaces stays until the next
    compaction, so readers that have started can finish.
    """
    bases = _bases(spark, totals_path)
    last = bases[-1] if bases else -1
    fresh = [n for n in _batches(spark, totals_path, last) if upto is None or n <= upto]
    fresh = [n for k, n in enumerate(fresh) if n == last + 1 + k]
    if not fresh:
        return None
    staged = f"{totals_path}/staged/{uuid.uuid4().hex}"
    merged_totals(spark, totals_path, fresh[-1]).write.parquet(staged, compression=TABLE_CODEC)
    make_folder(spark, f"{totals_path}/bases")
    rename_folder(spark, staged, f"{totals_path}/bases/{fresh[-1]}")
    for n in bases[:-1]:
        delete_folder(spark, f"{totals_path}/bases/{n}")
    for n in _batches(spark, totals_path, -1):
        if n <= last:
            delete_folder(spark, f"{totals_path}/batches/batch_id={n}")
    return fresh[-1]
