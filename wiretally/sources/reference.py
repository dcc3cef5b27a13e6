"""Reference-data sources: intel feeds, MIME types, blacklists, assets, word lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.functions.domains import is_fqdn
from wiretally.functions.net import with_addresses
from wiretally.sources.logs import _lines, read_zeek_json

# Columns of the findings report, in order, and the start of its header.
FINDINGS_COLUMNS = (
    "Severity",
    "Source IP",
    "Destination IP",
    "FQDN",
    "Beacon Score",
    "Strobe",
    "Total Duration",
    "Long Connection Score",
    "Subdomains",
    "C2 Over DNS Score",
    "Threat Intel",
    "Prevalence",
    "First Seen",
    "Missing Host Header",
    "Connection Count",
    "Total Bytes",
    "Port:Proto:Service",
    "Modifiers",
)
_COMMENTS = ("#", "//", "<!--")


def read_findings_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Findings report, skipping banner lines up to and including its header."""
    lines = _lines(spark, paths)
    starts = lines.filter(F.col("value").startswith("Severity,Source IP")).groupBy("file").agg(
        F.min("pos").alias("_start")
    )
    schema = ", ".join(f"`{c}` string" for c in FINDINGS_COLUMNS)
    return (
        lines.join(starts, "file")
        .filter((F.col("pos") > F.col("_start")) & (F.trim("value") != ""))
        .select(F.from_csv("value", schema).alias("_row"))
        .select(*[F.trim(F.col(f"_row.`{c}`")).alias(c) for c in FINDINGS_COLUMNS])
    )


def write_findings_csv(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").option("header", True).csv(path)


def read_intel_feed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One entry per line; comments and anything neither address nor name drop out."""
    entry = F.trim("value")
    kept = spark.read.text(paths).select(entry.alias("entry"), F.col("_metadata.file_path").alias("feed"))
    for mark in _COMMENTS:
        kept = kept.filter(~F.col("entry").startswith(mark))
    parsed = with_addresses(kept.filter(F.col("entry") != "").withColumn("ip", F.col("entry")), {"_hex": "ip"}, canonical=True)
    is_ip = F.col("_hex").isNotNull()
    return (
        parsed.filter(is_ip | is_fqdn("entry"))
        .select(
            "feed",
            F.when(is_ip, F.col("ip")).otherwise("").alias("ip"),
            F.when(is_ip, "").otherwise(F.col("entry")).alias("fqdn"),
        )
        .dropDuplicates()
    )


def sync_feeds(current: DataFrame, incoming: DataFrame, configured: DataFrame) -> DataFrame:
    """Entries after a sync: changed feeds replaced, removed feeds dropped, rest kept.

    Tables have feed, feed_hash, ip and fqdn; ``configured`` lists the feeds in use. A
    feed is changed when its hash differs; incoming rows of unchanged feeds are ignored.
    """
    live = current.join(configured.select("feed"), "feed", "left_semi")
    offered = incoming.join(configured.select("feed"), "feed", "left_semi")
    known = live.select("feed", "feed_hash").distinct()
    changed = offered.select("feed", "feed_hash").distinct().join(known, ["feed", "feed_hash"], "left_anti").select("feed").distinct()
    kept = live.join(changed, "feed", "left_anti")
    replaced = offered.join(changed, "feed", "left_semi")
    return kept.unionByName(replaced).dropDuplicates(["feed", "ip", "fqdn"])


def read_valid_mime(spark: SparkSession, path: str) -> DataFrame:
    """(mime_type, extension) pairs from a CSV; a cell may list several extensions,
    written with dots, and ``none`` stands for no extension."""
    rows = spark.read.option("header", True).csv(path)
    cell = F.coalesce(F.col(f"`{rows.columns[2]}`"), F.lit(""))
    plain = F.replace(F.when(cell == "none", "").otherwise(cell), F.lit("."), F.lit(""))
    parts = F.transform(F.split(plain, ","), lambda x: F.trim(x))
    listed = F.when(F.size(parts) > 1, F.filter(parts, lambda x: x != "")).otherwise(parts)
    return (
        rows.filter(F.length(F.col(f"`{rows.columns[1]}`")) > 0)
        .select(F.col(f"`{rows.columns[1]}`").alias("mime_type"), F.explode(listed).alias("extension"))
        .dropDuplicates()
    )


def read_scan_notices(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    from wiretally.operators.scan import SCAN_NOTES

    return read_zeek_json(spark, paths, "notice").filter(F.col("note").isin(*SCAN_NOTES))


def read_ja3_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """Blacklisted fingerprints: lower-cased 32-digit hex keys only."""
    schema = "map<string, struct<family:string, threat:string, confidence:string, source:string>>"
    text = spark.read.text(path, wholetext=True)  # one small reference file
    return (
        text.select(F.explode(F.from_json("value", schema)).alias("hash", "_v"))
        .select(F.lower(F.trim("hash")).alias("hash"), "_v.*")
        .filter(F.col("hash").rlike("^[0-9a-f]{32}$"))
    )


def assets_frame(spark: SparkSession, inventory: dict[str, dict]) -> DataFrame:
    """Asset inventory (ip -> name, criticality, zone) as a small table."""
    rows = [
        (ip, str(m.get("name", "Unknown Asset")), str(m.get("criticality", "unknown")), str(m.get("zone", "Unzoned")))
        for ip, m in inventory.items()
    ]
    return spark.createDataFrame(rows, "ip string, name string, criticality string, zone string")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Inventory from a JSON or YAML configuration file kept next to the job."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML needs PyYAML; use JSON instead") from error
        document = yaml.safe_load(text) or {}
    else:
        document = json.loads(text)
    return assets_frame(spark, document.get("assets", document))


def read_wordlist(spark: SparkSession, paths: str | list[str], min_length: int = 3) -> DataFrame:
    word = F.lower(F.trim("value"))
    return spark.read.text(paths).select(word.alias("word")).filter(F.length("word") >= min_length).distinct()


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """Bigram table written by :func:`wiretally.operators.dga.fit_bigrams`."""
    return spark.read.schema("bigram string, log10_p double").parquet(path)


def read_labeled_domains(spark: SparkSession, path: str) -> DataFrame:
    """Domains with ground truth from a JSON array or JSON lines."""
    rows = spark.read.schema("domain string, ground_truth string").option("multiLine", True).json(path)
    return rows.filter(F.col("domain").isNotNull()).select(
        "domain", (F.lower("ground_truth") == "dga").cast("int").alias("label01")
    )
