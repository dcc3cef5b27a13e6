"""Log sources: JSON-lines and tab-separated logs, discovery and the import ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Log fields by type, in the order of the log format.
_ID = {"id.orig_h": "addr", "id.orig_p": "port", "id.resp_h": "addr", "id.resp_p": "port"}
_HEAD = {"ts": "time", "uid": "string", **_ID}
_AGENT = {"agent_hostname": "string", "agent_uuid": "string"}
FIELDS: dict[str, dict[str, str]] = {
    "conn": {
        **_HEAD,
        "proto": "string",
        "service": "string",
        "duration": "interval",
        "orig_bytes": "count",
        "resp_bytes": "count",
        "conn_state": "string",
        "local_orig": "bool",
        "local_resp": "bool",
        "missed_bytes": "count",
        "history": "string",
        "orig_pkts": "count",
        "orig_ip_bytes": "count",
        "resp_pkts": "count",
        "resp_ip_bytes": "count",
        "tunnel_parents": "set[string]",
        **_AGENT,
    },
    "dns": {
        **_HEAD,
        "proto": "string",
        "trans_id": "count",
        "rtt": "interval",
        "query": "string",
        "qclass": "count",
        "qclass_name": "string",
        "qtype": "count",
        "qtype_name": "string",
        "rcode": "count",
        "rcode_name": "string",
        "AA": "bool",
        "TC": "bool",
        "RD": "bool",
        "RA": "bool",
        "Z": "count",
        "answers": "vector[string]",
        "TTLs": "vector[interval]",
        "rejected": "bool",
        **_AGENT,
    },
    "http": {
        **_HEAD,
        "trans_depth": "count",
        "method": "string",
        "host": "string",
        "uri": "string",
        "referrer": "string",
        "version": "string",
        "user_agent": "string",
        "origin": "string",
        "request_body_len": "count",
        "response_body_len": "count",
        "status_code": "count",
        "status_msg": "string",
        "info_code": "count",
        "info_msg": "string",
        "username": "string",
        "password": "string",
        "proxied": "set[string]",
        "orig_fuids": "vector[string]",
        "orig_filenames": "vector[string]",
        "orig_mime_types": "vector[string]",
        "resp_fuids": "vector[string]",
        "resp_filenames": "vector[string]",
        "resp_mime_types": "vector[string]",
        **_AGENT,
    },
    "ssl": {
        **_HEAD,
        "version": "string",
        "cipher": "string",
        "curve": "string",
        "server_name": "string",
        "resumed": "bool",
        "last_alert": "string",
        "next_protocol": "string",
        "established": "bool",
        "cert_chain_fuids": "vector[string]",
        "client_cert_chain_fuids": "vector[string]",
        "subject": "string",
        "issuer": "string",
        "client_subject": "string",
        "client_issuer": "string",
        "validation_status": "string",
        "ja3": "string",
        "ja3s": "string",
        **_AGENT,
    },
    "notice": {
        "ts": "time",
        "uid": "string",
        "note": "string",
        "msg": "string",
        "sub": "string",
        "src": "addr",
        "dst": "addr",
        "p": "count",
        "n": "count",
        "actions": "set[string]",
    },
}
REQUIRED = ("ts", "id.orig_h", "id.resp_h")
# Names given to the endpoint fields.
RENAMED = {"id.orig_h": "src", "id.orig_p": "src_port", "id.resp_h": "dst", "id.resp_p": "dst_port",
           "resp_mime_types": "dst_mime_types"}
# Marks of an absent value.
UNSET, EMPTY = "-", "(empty)"
BAD_LINE_LIMIT = 25

_PREFIXES = ("conn", "open_conn", "dns", "http", "open_http", "ssl", "open_ssl")


def coerce_zeek(value: Column, kind: str, json: bool = False) -> Column:
    """Typed value of a log field; marks of absence and unparsable text give NULL.

    Times are epoch seconds (whole or fractional) or RFC 3339 text. List fields are
    comma-separated in tab-separated logs and JSON arrays in JSON logs.
    """
    text = F.when(~value.isin(UNSET, EMPTY, ""), value)
    if kind == "time":
        micros = F.round(text.try_cast("double") * 1_000_000).cast("bigint")
        return F.coalesce(F.timestamp_micros(micros), F.try_to_timestamp(text))
    if kind == "interval":
        return text.try_cast("double")
    if kind == "count":
        return F.coalesce(text.try_cast("bigint"), text.try_cast("double").cast("bigint"))
    if kind == "port":
        return text.try_cast("int")
    if kind == "bool":
        return F.when(F.lower(text).isin("t", "true"), True).when(F.lower(text).isin("f", "false"), False)
    if kind.startswith(("set[", "vector[")):
        items = F.from_json(text, "array<string>") if json else F.split(text, ",")
        inner = "double" if "interval" in kind else "string"
        return F.transform(items, lambda x: x.try_cast(inner))
    return text


def _typed(df: DataFrame, log_type: str, value_of, json: bool, extra: list[str]) -> DataFrame:
    fields = FIELDS[log_type]
    out = df.select(
        *[
            coerce_zeek(value_of(name), kind, json).alias(RENAMED.get(name, name))
            for name, kind in fields.items()
        ],
        *extra,
    )
    needed = [RENAMED.get(n, n) for n in REQUIRED if n in fields]
    for name in needed:
        out = out.filter(F.col(name).isNotNull())
    return out


def read_zeek_json(spark: SparkSession, paths: str | list[str], log_type: str) -> DataFrame:
    """JSON-lines log; comments, malformed rows and rows without endpoints drop out.

    Every field is read as text and coerced, so one odd value costs a NULL, not the row.
    """
    names = list(FIELDS[log_type])
    schema = ", ".join(f"`{n}` string" for n in names) + ", _corrupt string"
    rows = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(paths)
        .filter(F.col("_corrupt").isNull())
    )
    return _typed(rows, log_type, lambda n: F.col(f"`{n}`"), True, [])


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their file and a position that orders the lines of a file."""
    return spark.read.text(paths).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"),
    )


def read_headers(lines: DataFrame) -> DataFrame:
    """One row per file: field names and separator of a tab-separated log."""
    line = F.col("value")
    mark = line.startswith("#separator") | line.startswith("#fields")
    sep_code = F.regexp_extract(line, r"^#separator\s+\\x([0-9a-fA-F]{2})", 1)
    return (
        lines.filter(mark)
        .groupBy("file")
        .agg(
            F.max(F.when(line.startswith("#separator"), F.decode(F.unhex(sep_code), "UTF-8"))).alias("sep"),
            F.max(F.when(line.startswith("#fields"), line)).alias("fields"),
        )
        .withColumn("sep", F.coalesce("sep", F.lit("\t")))
        .filter(F.col("fields").isNotNull())
        .withColumn("names", F.expr("slice(split(fields, concat('\\\\Q', sep, '\\\\E')), 2, 10000)"))
        .select("file", "sep", "names")
    )


def read_zeek_tsv(spark: SparkSession, paths: str | list[str], log_type: str) -> DataFrame:
    """Tab-separated log, plain or gzip, columns taken by the names of its own header.

    Unknown fields are skipped and absent ones are NULL. Headers are one row per file; how
    they are joined is left to the planner, which knows their size.
    """
    lines = _lines(spark, paths)
    headers = read_headers(lines)
    rows = (
        lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
        .join(headers, "file")
        .withColumn("cells", F.expr("split(value, concat('\\\\Q', sep, '\\\\E'))"))
        .filter(F.size("cells") == F.size("names"))
        .withColumn("by_name", F.map_from_arrays("names", "cells"))
    )
    return _typed(rows, log_type, lambda n: F.try_element_at("by_name", F.lit(n)), False, [])


def file_quality(spark: SparkSession, paths: str | list[str], limit: int = BAD_LINE_LIMIT) -> DataFrame:
    """Bad lines per file; a file is corrupt with more than ``limit`` or a cut-off end.

    A JSON line is bad when it does not parse; a tab-separated one when its number of
    cells differs from the header. The whole file is judged.
    """
    lines = _lines(spark, paths)
    headers = read_headers(lines)
    line = F.col("value")
    cells = F.size(F.expr("split(value, concat('\\\\Q', sep, '\\\\E'))"))
    bad = F.when(line.startswith("{"), F.try_parse_json(line).isNull()).otherwise(
        F.coalesce(cells != F.size("names"), F.lit(True))
    )
    return (
        lines.filter((F.trim("value") != "") & ~line.startswith("#"))
        .join(headers, "file", "left")
        .withColumn("bad", bad)
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if("bad").alias("bad_lines"),
            F.max_by("bad", "pos").alias("cut_off"),
        )
        .withColumn("corrupt", (F.col("bad_lines") > limit) | F.col("cut_off"))
    )


# ---- discovery and ledger ----------------------------------------------------------


def classify_files(files: DataFrame) -> DataFrame:
    """Log files (path, modificationTime) with type, day folder and hour.

    Only ``.log`` and ``.log.gz`` count; of both, the newer one stays. The hour comes
    from a name like ``conn.13:00:00-14:00:00.log.gz`` and defaults to 0.
    """
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    kind = F.regexp_extract(name, rf"^({'|'.join(sorted(_PREFIXES, key=len, reverse=True))})[._]", 1)
    newest = Window.partitionBy("_stem").orderBy(F.desc("modificationTime"), F.desc("path"))
    return (
        files.filter(name.rlike(r"\.(log|log\.gz)$") & ~name.startswith("conn_summary"))
        .withColumn("log_type", kind)
        .filter(F.col("log_type") != "")
        .withColumn("day", F.try_to_date(F.regexp_extract(folder, r"(\d{4}-\d{2}-\d{2})", 1)))
        .withColumn("hour", F.coalesce(F.regexp_extract(name, r"\.(\d{2}):", 1).try_cast("int"), F.lit(0)))
        .withColumn("_stem", F.regexp_replace("path", r"\.gz$", ""))
        .withColumn("_rn", F.row_number().over(newest))
        .filter("_rn = 1")
        .drop("_rn", "_stem")
    )


def discover_logs(spark: SparkSession, root: str) -> DataFrame:
    """Log files below a folder. Only file metadata is listed; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "modificationTime", "length")
    )
    return classify_files(files)


def keep_recent_days(files: DataFrame, days: int, today: Column | None = None) -> DataFrame:
    """Only the last ``days`` days, provided any file is that recent; else all."""
    oldest = F.date_sub(F.current_date() if today is None else today, days)
    newest = files.agg(F.max("day").alias("_newest"))
    return (
        files.crossJoin(F.broadcast(newest))  # one row
        .filter((F.col("_newest") < oldest) | F.col("_newest").isNull() | (F.col("day") >= oldest))
        .drop("_newest")
    )


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files not imported before."""
    return files.join(ledger.select("path").distinct(), "path", "left_anti")


def valid_combinations(files: DataFrame) -> DataFrame:
    """Drop HTTP and TLS logs of hours without the connection log they link to."""
    per_hour = files.groupBy("day", "hour").agg(
        F.max(F.col("log_type") == "conn").alias("_conn"),
        F.max(F.col("log_type") == "open_conn").alias("_open"),
    )
    kind = F.col("log_type")
    keep = (
        F.when(kind.isin("http", "ssl"), F.col("_conn"))
        .when(kind.isin("open_http", "open_ssl"), F.col("_open"))
        .otherwise(True)
    )
    hours = per_hour.withColumnRenamed("day", "_day").withColumnRenamed("hour", "_hour")
    return (
        files.join(hours, F.col("day").eqNullSafe(F.col("_day")) & (F.col("hour") == F.col("_hour")))
        .filter(keep)
        .drop("_day", "_hour", "_conn", "_open")
    )


def import_record(conn: DataFrame, import_id: str, started: Column, ended: Column) -> DataFrame:
    """Ledger row of a finished import with the time it covers."""
    return conn.agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")).select(
        F.lit(import_id).alias("import_id"), started.alias("started_at"), ended.alias("ended_at"), "min_ts", "max_ts"
    )


def append_import_log(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)
