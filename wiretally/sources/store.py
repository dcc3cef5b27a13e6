"""Alert store: upserts, scoped deletes, retention and exports.

Tables are Parquet folders partitioned by capture. A Parquet folder has no row updates,
so a change computes the new content of the touched partitions and overwrites those only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from wiretally.session import materialise

# Columns an alert upsert replaces; all others keep their first value.
REPLACED = (
    "severity",
    "asset_criticality",
    "correlation_id",
    "supporting_evidence",
    "pcap_id",
)
#: Raw and correlated ids of alerts, a row each.
LISTS = "alert_id string, list string, item string"
# Lifetimes by kind of table, in seconds, and the seconds of time one partition holds.
LIFETIMES = {
    "logs": (26 * 3600, 3600),
    "scores": (14 * 86400, 86400),
    "files": (180 * 86400, 86400),
    "imports": (365 * 86400, 86400),
}


def merge(base: DataFrame, incoming: DataFrame, key: str, replaced: tuple[str, ...] | None) -> DataFrame:
    """Rows of both sides by key; on conflict ``replaced`` columns come from incoming.

    ``replaced`` None means every non-NULL incoming value wins (a partial update).
    """
    columns = [c for c in base.columns if c != key]
    left = base.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in_base"))
    right = incoming.select(
        key,
        *[(F.col(c) if c in incoming.columns else F.lit(None).cast(base.schema[c].dataType)).alias(f"_n_{c}") for c in columns],
        F.lit(True).alias("_in_new"),
    )
    both = F.col("_in_base").isNotNull() & F.col("_in_new").isNotNull()

    def pick(c: str) -> Column:
        old, new = F.col(f"_b_{c}"), F.col(f"_n_{c}")
        if replaced is None:
            return F.coalesce(new, old).alias(c)
        on_conflict = new if c in replaced else old
        return F.when(both, on_conflict).when(F.col("_in_base").isNotNull(), old).otherwise(new).alias(c)

    return left.join(right, key, "full_outer").select(key, *[pick(c) for c in columns])


def newest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: a batch may hold a key more than once."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def upsert_alerts(base: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge(base, incoming, "alert_id", REPLACED)


def _part() -> Column:
    """Partition of an alert: its capture, in a form that a folder name keeps (no capture: ``p``)."""
    return F.concat(F.lit("p"), F.coalesce("pcap_id", F.lit(""))).alias("part")


def _manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Number of the newest finished manifest and its rows (part, version); 0 and no rows in a new store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [status.getPath() for status in files.globStatus(folder.suffix("/n=*/_SUCCESS"))]
    newest = max((int(place.getParent().getName().removeprefix("n=")) for place in found), default=0)
    schema = "part string, version int"
    if not newest:
        return 0, spark.createDataFrame([], schema)
    return newest, spark.read.schema(schema).parquet(f"{path}/manifest/n={newest}")


def _live(spark: SparkSession, path: str, table: str, manifest: DataFrame, schema: str | StructType) -> DataFrame:
    """Rows of a table in the folders that the manifest names; Spark prunes the others by their names."""
    known = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = [*known.fields, StructField("version", IntegerType()), StructField("part", StringType())]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], StructType(fields))
    return spark.read.schema(StructType(fields)).parquet(f"{path}/{table}").join(manifest, ["part", "version"], "left_semi")


def read_alerts(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """Alerts of the store and their lists (alert_id, list, item)."""
    _, manifest = _manifest(spark, path)
    alerts, lists = _live(spark, path, "alerts", manifest, schema), _live(spark, path, "lists", manifest, LISTS)
    return alerts.drop("part", "version"), lists.drop("part", "version")


def upsert_with_lists(spark: SparkSession, path: str, incoming: DataFrame, lists: DataFrame) -> int:
    """Upsert alerts, one row per ``alert_id``, with their lists (alert_id, list, item) of raw and correlated ids.

    An alert that comes again has its lists replaced as a whole, even by none; the others keep
    theirs. Lists of alerts that do not come are ignored, and so are repeated items. Only captures that the alerts
    come from or were in before are rewritten, into folders of a new version. The new manifest, written
    last, switches all tables at once: before it is finished, readers see the old state, and a repeated call
    overwrites what a killed one left behind. One writer at a time. Returns the version.
    """
    before, manifest = _manifest(spark, path)
    version = before + 1
    incoming = materialise(incoming, "incoming-alerts")
    ids = incoming.select("alert_id")
    alerts = _live(spark, path, "alerts", manifest, incoming.schema)
    homes = alerts.join(ids, "alert_id", "left_semi").select("part")
    touched = materialise(incoming.select(_part()).union(homes).distinct(), "touched-captures")
    base = alerts.join(touched, "part", "left_semi").drop("part", "version")
    merged = materialise(upsert_alerts(base, incoming).select(*incoming.columns, _part()), "merged-alerts")
    kept = _live(spark, path, "lists", manifest, LISTS).join(touched, "part", "left_semi").select("alert_id", "list", "item")
    items = kept.join(ids, "alert_id", "left_anti").union(lists.select("alert_id", "list", "item").join(ids, "alert_id", "left_semi"))
    items = items.distinct().join(merged.select("alert_id", "part"), "alert_id")
    for table, rows in (("alerts", merged), ("lists", items)):
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/{table}/version={version}")
    current = manifest.join(touched, "part", "left_anti").union(touched.select("part", F.lit(version).alias("version")))
    current.write.mode("overwrite").parquet(f"{path}/manifest/n={version}")
    return version


def upsert_analysis(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Session records: given fields replace, absent ones stay."""
    return merge(base, incoming, "pcap_id", None)


def delete_scope(df: DataFrame, pcap_id: str) -> DataFrame:
    """Everything but one capture."""
    return df.filter(~F.col("pcap_id").eqNullSafe(F.lit(pcap_id)))


def overwrite_partitions(df: DataFrame, path: str, partition: str = "pcap_id") -> None:
    """Replace only the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def apply_retention(df: DataFrame, column: str, keep: str, now: Column | None = None) -> DataFrame:
    """Rows younger than ``keep`` (an interval such as ``26 HOURS``)."""
    return df.filter(F.col(column) >= (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {keep}"))


def write_by_time(df: DataFrame, path: str, column: str, unit: int) -> None:
    """Write (or add to) a table filed by stretches of ``unit`` seconds of ``column``."""
    slot = F.floor(F.unix_seconds(column) / unit)
    filed = df.withColumn("slot", slot).repartition("slot")
    filed.write.mode("append").partitionBy("slot").parquet(path)


def drop_expired(spark: SparkSession, path: str, column: str, keep: int, unit: int, now: int) -> dict[str, int]:
    """Remove what is older than ``keep`` seconds before ``now`` (seconds since 1970) from a :func:`write_by_time` table.

    Whole partitions are deleted unread, by their names; only the one that the limit falls into is
    read, and its recent rows replace it. A repeated call changes nothing; one that was cut off is
    made good by the next. Returns how many partitions were dropped and rewritten. Only rolling
    data sets have lifetimes: do not call it for others.
    """
    limit = now - keep
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    slots = [status.getPath() for status in files.listStatus(folder) if status.getPath().getName().startswith("slot=")]
    done = {"dropped": 0, "rewritten": 0}
    for place in slots:
        slot = int(place.getName().removeprefix("slot="))
        if (slot + 1) * unit <= limit:
            files.delete(place, True)
            done["dropped"] += 1
        elif slot * unit < limit:
            border = spark.read.parquet(path).where(F.col("slot") == slot)
            recent = materialise(border.where(F.unix_micros(column) >= limit * 1_000_000), "border")
            overwrite_partitions(recent, path, "slot")
            if not recent.take(1):
                files.delete(place, True)
            done["rewritten"] += 1
    return done


def write_alerts_json(alerts: DataFrame, path: str) -> DataFrame:
    """Write alerts as JSON lines; returns the one-row-per-detector run summary."""
    alerts.write.mode("overwrite").json(path)
    return alerts.groupBy("detector", "threat_class").agg(
        F.count(F.lit(1)).alias("alerts"), F.max("confidence").alias("max_confidence")
    )


def write_features(features: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write a feature table; returns its summary (rows, columns, nulls are impossible
    after preparation, so the means are reported)."""
    writer = features.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    numeric = [f.name for f in features.schema if f.dataType.typeName() == "double"]
    return features.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(features.columns)).alias("columns"),
        *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in numeric],
    )


def list_datasets(imports: DataFrame) -> DataFrame:
    """Datasets with the time they cover, clamped to the last two weeks."""
    return (
        imports.groupBy("dataset", "rolling")
        .agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
        .withColumn("min_ts", F.greatest("min_ts", F.col("max_ts") - F.expr("INTERVAL 14 DAYS")))
    )


def with_sample_flag(datasets: DataFrame, samples: DataFrame) -> DataFrame:
    """Mark datasets that are sample databases."""
    flags = samples.select("dataset").distinct().withColumn("is_sample", F.lit(True))
    return datasets.join(flags, "dataset", "left").withColumn("is_sample", F.coalesce("is_sample", F.lit(False)))
