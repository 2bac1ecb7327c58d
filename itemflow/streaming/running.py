"""Structured Streaming forms of the stateful operators: accumulators, windows, iterate with state.

The batch operators have no event time of their own; these are their continuous counterparts.  Each takes a
streaming DataFrame or a folder of files, keeps its state in Spark's state store and writes where ``start``
says.  ``drained`` runs a query over what is there, writes its result as a table and reads that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over all that is available; its result, read from the table it is written to."""
    from ..scratch import folder

    spark = df.sparkSession
    at, out = folder(spark, "stream"), folder(spark, "result")

    def write(batch: DataFrame, number: int) -> None:
        # in complete mode each batch has the whole result, in the others what is new; a batch that runs again replaces itself
        batch.write.mode("overwrite").parquet(f"{out}/__batch={0 if mode == 'complete' else number}")

    spark.createDataFrame([], df.schema).write.parquet(f"{out}/__batch=-1")  # a stream without rows has a result too
    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out).select(*df.columns)


def accumulate(stream: DataFrame, keys: list[str], aggregates: dict[str, str]) -> DataFrame:
    """Running value of each key: aggregates are SQL; use with output mode complete or update."""
    return stream.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])


def totals(spark: SparkSession, path: str, keys: list[str], aggregates: dict[str, str]) -> DataFrame:
    return drained(accumulate(source(spark, path), keys, aggregates), "complete")


def windows(stream: DataFrame, ts: str, size: str, keys: list[str], late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts of tumbling or sliding windows; rows later than ``late`` behind the newest are dropped in append mode."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stamped.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), *keys, "n")


def windowed(spark: SparkSession, path: str, ts: str, size: str, keys: list[str]) -> DataFrame:
    return drained(windows(source(spark, path), ts, size, keys), "complete")


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """group-adjacent by time: sessions that end after ``gap`` without rows."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def iterate(stream: DataFrame, keys: list[str], state: dict, step: Callable[[dict, dict], tuple[dict, dict | None]], schema: str, state_schema: str, order: str) -> DataFrame:
    """xsl:iterate on a stream: state is kept for each key between batches; rows of a batch come in ``order``."""
    fields = list(state)

    def run(key: tuple, batches: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        now = dict(zip(fields, store.get, strict=True)) if store.exists else dict(state)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for row in rows.to_dict("records"):
            now, written = step(row, now)
            if written is not None:
                out.append(written)
        store.update(tuple(now[f] for f in fields))
        if out:
            yield pd.DataFrame(out)

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "append", "NoTimeout")
