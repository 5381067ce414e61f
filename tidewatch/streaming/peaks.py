"""Peak use of sessions from a stream of samples.

The same plan serves a stream and a table: watermarks mean nothing to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_peaks(
    samples: DataFrame, value: str = "temp_space_allocated", min_value: float = 2 * 1024 * 1048576, moment: str = "1 hour", span: str = "1 day",
    late: str = "2 days", time: str = "sample_time",
) -> DataFrame:
    """Every session's highest use in each span of time, parallel children added to their parent.

    Samples of one ``moment`` belong together. A child names its parent's session (``qc_instance_id``,
    ``qc_session_id``, ``qc_session_serial``); children without a sample of their parent do not
    count, nor do totals under ``min_value``. Of equal peaks the later moment counts. Samples may come
    in any order, as long as none is later than ``late`` behind the newest one; rows come out once,
    when the watermark has passed their span. Both sums are added up before they shuffle, and
    the state holds one row per session and open moment or span.
    """
    own = {"inst_id": "qc_instance_id", "session_id": "qc_session_id", "session_serial": "qc_session_serial"}
    child = F.col("qc_instance_id").isNotNull()
    rows = samples.withWatermark(time, late)
    totals = rows.groupBy(
        F.window(time, moment).alias("moment"), *[F.when(child, F.col(c)).otherwise(F.col(p)).alias(p) for p, c in own.items()]
    ).agg(F.sum(value).alias("total"), F.count_if(~child).alias("parents"), F.count_if(child).alias("child_rows"))
    large = totals.where((F.col("parents") > 0) & (F.col("total") >= min_value))
    best = F.max(F.struct("total", F.col("moment.start").alias("at"), "child_rows")).alias("best")
    peaks = large.groupBy(F.window(F.window_time("moment"), span).alias("span"), *own).agg(best)
    return peaks.select(
        F.col("span.start").alias("span_start"), *own, F.col("best.total").alias("peak_value"), F.col("best.at").alias("peak_at"), "best.child_rows")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Takes in all input that is there, appends what is finished to a Parquet table, and reads the table.

    A later call with the same folders goes on where this one ended; one that was killed repeats
    its last batch, whose rows the table holds once.
    """
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
