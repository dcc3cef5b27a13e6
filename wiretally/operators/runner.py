"""One run of all detectors: their alerts in one table, and how each of them fared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.operators.hourly import union_all
from wiretally.session import materialise


def run_detectors(
    spark: SparkSession, detectors: dict[str, Callable[[], DataFrame]]
) -> tuple[DataFrame | None, DataFrame]:
    """(alerts, status) of ``detectors``: name -> function that returns alerts.

    Alerts of each detector are written to the shared folder, so a detector that fails is known
    at once and does not stop the others. Status has one row per detector: detector, status
    (``ok`` or ``failed``), error, alerts. Without any success there are no alerts.
    """
    done, rows = {}, []
    for name, make in detectors.items():
        try:
            done[name] = materialise(make(), "alerts")
            rows.append((name, "ok", ""))
        except Exception as error:  # noqa: BLE001  whatever goes wrong is the detector's status
            rows.append((name, "failed", type(error).__name__))
    status = spark.createDataFrame(rows, "detector string, status string, error string")
    counts = [df.agg(F.count(F.lit(1)).alias("alerts")).withColumn("detector", F.lit(name)) for name, df in done.items()]
    if not counts:
        return None, status.withColumn("alerts", F.lit(None).cast("bigint"))
    return union_all(list(done.values())), status.join(union_all(counts), "detector", "left")
