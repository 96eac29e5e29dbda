"""Operators on time series of measurements, batch and streaming alike unless stated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmesh.operators.relational import running_total

#: Measured columns and what a reading must lie in.
PERCENTAGES = ["cpu_usage", "ram_usage_percent", "gpu_utilization", "vram_usage_percent", "power_usage_percent"]


def valid_readings(samples: DataFrame) -> DataFrame:
    """Percentages outside 0..100 become null; the sample stays."""
    return samples.withColumns({c: F.when(F.col(c).between(0, 100), F.col(c)) for c in PERCENTAGES if c in samples.columns})


def first_of_sample(samples: DataFrame) -> DataFrame:
    """A sample sent twice counts once: the least id of a session and time (batch)."""
    columns = [F.col(f"`{c}`") for c in samples.columns]
    return samples.groupBy("session_id", "sample_ts").agg(F.min_by(F.struct(*columns), "sample_id").alias("r")).select("r.*")


def tumbling(samples: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(session_id, window_start, window_end, samples, averages and greatest values).

    With ``late`` a streaming input gets that watermark and each sample is taken once.
    """
    if late is not None:
        samples = samples.withWatermark("sample_ts", late).dropDuplicatesWithinWatermark(["session_id", "sample_ts"])
    out = samples.groupBy("session_id", F.window("sample_ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("cpu_usage").alias("avg_cpu"), F.max("cpu_usage").alias("max_cpu"), F.avg("ram_usage_percent").alias("avg_ram"), F.avg("gpu_utilization").alias("avg_gpu")
    )
    return out.select("session_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "samples", "avg_cpu", "max_cpu", "avg_ram", "avg_gpu")


def sliding(samples: DataFrame, width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """(session_id, window_start, samples, avg_cpu): overlapping windows."""
    out = samples.groupBy("session_id", F.window("sample_ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("samples"), F.avg("cpu_usage").alias("avg_cpu"))
    return out.select("session_id", F.col("w.start").alias("window_start"), "samples", "avg_cpu")


def bursts(samples: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(session_id, burst_start, burst_end, samples): stretches without a pause of ``gap`` or more."""
    out = samples.groupBy("session_id", F.session_window("sample_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("samples"))
    return out.select("session_id", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "samples")


#: Samples of a session that one task reads through.
BLOCK = 100_000


def history(samples: DataFrame, size: int = 100) -> DataFrame:
    """Every sample with count and mean CPU of the last ``size`` of its session, itself included (batch).

    Samples are numbered by days of their session (``running_total``) and read in
    blocks of ``BLOCK`` numbers, with the ``size`` - 1 samples before a block carried
    over into it; so a hot session is many tasks' work.
    """
    columns = samples.select("sample_id", "session_id", "sample_ts", "cpu_usage")
    numbered = running_total(columns, ["session_id"], ["sample_ts", "sample_id"], F.to_date("sample_ts"), F.lit(1), "_n")
    own = F.floor(F.col("_n") / BLOCK)
    reaches = F.floor((F.col("_n") + size - 1) / BLOCK)
    placed = numbered.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, reaches)))
    frame = Window.partitionBy("session_id", "_block").orderBy("_n").rowsBetween(1 - size, Window.currentRow)
    read = placed.withColumns({"in_history": F.count(F.lit(1)).over(frame), "mean_cpu": F.avg("cpu_usage").over(frame)})
    return read.where("_own = _block").select("sample_id", "session_id", "sample_ts", "in_history", "mean_cpu")


def latest(samples: DataFrame, size: int = 100) -> DataFrame:
    """The last ``size`` samples of each session, newest first (batch). Each task keeps its last ``size`` of a session before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("sample_ts"), F.desc("sample_id")))
    return samples.withColumn("_rank", rank).where(F.col("_rank") <= size).withColumn("age", F.col("_rank") - 1).drop("_rank")


def as_csv_rows(samples: DataFrame) -> DataFrame:
    """Columns of the metrics file in its order; nulls empty."""
    return samples.select(F.date_format("sample_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*PERCENTAGES, "power_limit_percent")))


def csv_sink(stream: DataFrame, folder: str, checkpoint: str, every: str = "5 seconds"):
    """Start a stream that appends metrics files."""
    return as_csv_rows(stream).writeStream.format("csv").option("header", True).option("path", folder).option("checkpointLocation", checkpoint).trigger(processingTime=every).outputMode("append").start()


class RecentSamples(StatefulProcessor):
    """Keeps the last ``size`` samples of a session in state and emits their count and mean CPU per batch."""

    def __init__(self, size: int = 100):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "times array<long>, values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.kept.get() if self.kept.exists() else None
        pairs = list(zip(state[0], state[1])) if state else []
        for batch in rows:
            pairs += list(zip(batch["t"].tolist(), batch["cpu_usage"].tolist()))
            pairs = sorted(pairs, key=lambda p: p[0])[-self.size :]
        self.kept.update(([t for t, _ in pairs], [float(v) for _, v in pairs]))
        known = [v for _, v in pairs if v == v]
        yield pd.DataFrame({"session_id": [key[0]], "in_history": [len(pairs)], "mean_cpu": [sum(known) / len(known) if known else None]})

    def close(self) -> None:
        pass


def recent_stream(stream: DataFrame, size: int = 100) -> DataFrame:
    """Streaming form of ``history``: one row per session and batch. Needs the RocksDB state store."""
    keyed = stream.select("session_id", F.unix_micros(F.col("sample_ts").cast("timestamp")).alias("t"), "cpu_usage")
    return keyed.groupBy("session_id").transformWithStateInPandas(RecentSamples(size), "session_id long, in_history long, mean_cpu double", "update", "none")
