"""Joins between log types by connection uid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions.net import conn_key

_CARRIED = ("src_ip_bytes", "dst_ip_bytes", "src_bytes", "dst_bytes", "src_packets", "dst_packets")


def rank_requests(http: DataFrame, *within: str) -> DataFrame:
    """All requests with their rank within the connection (or ``within`` other columns), newest first."""
    newest = Window.partitionBy(*(within or ("zeek_uid",))).orderBy(
        F.desc("ts"), F.desc("trans_depth"), "uri", "host", "method", "user_agent"
    )
    return http.withColumn("rn", F.row_number().over(newest))


def carried(conn: DataFrame, *extra: str) -> DataFrame:
    """What a connection passes on to its requests and handshakes."""
    return conn.select(
        "zeek_uid",
        F.col("hash").alias("conn_hash"),
        F.col("ts").alias("conn_ts"),
        "proto",
        "service",
        "duration",
        "conn_state",
        *_CARRIED,
        *extra,
    )


def link_http(http: DataFrame, conn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(linked requests, extra connection rows for requests without a host).

    Only the newest request carries the traffic of its connection; older ones are marked
    ``multi_request`` and count zero. ``conn`` must still hold its filtered rows.
    """
    return finish_http(rank_requests(http).drop("hash").join(carried(conn), "zeek_uid"))


def _by_uid(log: DataFrame) -> DataFrame:
    return log.withColumn("uid", F.coalesce(F.col("uid").cast("string"), F.lit("")))


def join_requests(http: DataFrame, conn: DataFrame, *extra: str) -> DataFrame:
    """Requests ranked and joined to their connections, which carry ``uid`` and ``extra``.

    The join is on the uid as logged: the longer key made of it follows once rows are where they
    belong, so it is not shuffled.
    """
    ranked = rank_requests(_by_uid(http.drop("hash", "zeek_uid")), "uid")
    linked = ranked.join(_by_uid(carried(conn, "uid", *extra).drop("zeek_uid")), "uid")
    return linked.withColumn("zeek_uid", conn_key("uid"))


def join_handshakes(ssl: DataFrame, conn: DataFrame, *extra: str) -> DataFrame:
    """Handshakes joined to their connections like :func:`join_requests`, without a rank."""
    linked = _by_uid(ssl.drop("zeek_uid")).join(_by_uid(carried(conn, "uid", *extra).drop("zeek_uid", "conn_hash")), "uid")
    return linked.withColumn("zeek_uid", conn_key("uid"))


def finish_http(ranked: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """:func:`link_http` from requests that are ranked and joined to their connections.

    ``keep`` names further columns of the connections to pass on.
    """
    newest = F.col("rn") == 1
    linked = ranked
    for column in _CARRIED:
        linked = linked.withColumn(column, F.when(newest, F.col(column)).otherwise(F.lit(0)))
    linked = (
        linked.withColumn("duration", F.when(newest, F.col("duration")).otherwise(0.0))
        .withColumn("conn_state", F.when(newest, F.col("conn_state")).otherwise(""))
        .withColumn("multi_request", ~newest)
        .withColumn("ts", F.col("conn_ts"))
        .drop("rn", "conn_ts")
    )
    no_host = F.col("host") == ""
    requests = (
        linked.filter(~no_host | ~F.col("pair_filtered"))
        .withColumn(
            "hash",
            F.when(no_host, F.col("conn_hash")).otherwise(F.md5(F.concat("src", "src_nuid", "host"))),
        )
        .drop("conn_hash", "pair_filtered")
    )
    icmp = F.col("proto") == "icmp"
    extra = linked.filter(no_host & ~F.col("pair_filtered")).select(
        "ts",
        "zeek_uid",
        F.col("conn_hash").alias("hash"),
        *("src", "dst", "src_nuid", "dst_nuid", "src_port", "dst_port", "src_local", "dst_local"),
        F.lit("").alias("proto"),
        F.lit("").alias("service"),
        F.lit("").alias("conn_state"),
        F.lit(0.0).alias("duration"),
        F.when(icmp, F.col("src_port")).otherwise(-1).alias("icmp_type"),
        F.when(icmp, F.col("dst_port")).otherwise(-1).alias("icmp_code"),
        *[F.lit(0).cast("bigint").alias(c) for c in _CARRIED],
        F.lit(True).alias("missing_host_header"),
        F.coalesce("user_agent", F.lit("")).alias("missing_host_useragent"),
        *keep,
    )
    return requests, extra


def link_ssl(ssl: DataFrame, conn: DataFrame) -> DataFrame:
    """Handshakes with the traffic of their connection (no ranking)."""
    return finish_ssl(ssl.join(carried(conn).drop("conn_hash"), "zeek_uid"))


def finish_ssl(joined: DataFrame) -> DataFrame:
    return (
        joined.withColumn("hash", F.md5(F.concat("src", "src_nuid", "server_name")))
        .withColumn("ts", F.col("conn_ts"))
        .drop("conn_ts")
    )


def row_mark(log: DataFrame) -> F.Column:
    """A hash of all columns and of which are null: tells the rows of one connection apart."""
    columns = [F.col(f"`{c}`") for c in log.columns]
    return F.xxhash64(*columns, *(c.isNull() for c in columns))


def link_stream(log: DataFrame, conn: DataFrame, lateness: str, window: str, *extra: str) -> DataFrame:
    """Rows of a log stream joined to the connections they belong to, whichever comes first.

    Both sides carry a watermark and a row waits for its partner for ``window`` of event time,
    which bounds the state. A row older than the watermark is dropped and counted by the query.
    Of both only the connection, time and mark (:func:`row_mark`) wait; :func:`linked_rows` adds the rest.
    """
    log = log.select("zeek_uid", "ts", row_mark(log).alias("mark")).withWatermark("ts", lateness)
    passed = carried(conn, *extra)
    conn = passed.select(F.col("zeek_uid").alias("conn_uid"), "conn_ts", row_mark(passed).alias("conn_mark"))
    near = F.expr(f"ts >= conn_ts - INTERVAL {window} AND ts <= conn_ts + INTERVAL {window}")
    linked = log.join(conn.withWatermark("conn_ts", lateness), (F.col("zeek_uid") == F.col("conn_uid")) & near)
    return linked.drop("conn_uid")


def linked_rows(log: DataFrame, conn: DataFrame, links: DataFrame, *extra: str) -> DataFrame:
    """The links of :func:`link_stream` with all columns of their rows of ``log``, which has their ``mark``, and
    with what their connections pass on.

    Rows that are equal in all columns have one mark and as many links as they are.
    """

    def once(rows: DataFrame, mark: str) -> DataFrame:
        first = Window.partitionBy("zeek_uid", mark).orderBy(mark)
        return rows.withColumn("_copy", F.row_number().over(first)).filter("_copy = 1").drop("_copy")

    passed = carried(conn, *extra)
    passed = once(passed.withColumn("conn_mark", row_mark(passed)), "conn_mark").drop("conn_ts")
    known = links.drop("ts").join(passed, ["zeek_uid", "conn_mark"]).drop("conn_mark")
    return once(log, "mark").join(known, ["zeek_uid", "mark"]).drop("mark")


def sni_uids(
    usni_totals: DataFrame,
    sni_keys: DataFrame,
    open_sni_keys: DataFrame,
    *,
    min_unique_ts: int = 4,
    strobe: int = 86_400,
    long_connection: float = 3600.0,
) -> DataFrame:
    """uids used by server-name pairs that will be scored, plus all open ones.

    ``usni_totals``: hash, ts_unique, count, total_duration; the key tables: hash, zeek_uid.
    """
    scored = usni_totals.filter(
        ((F.col("ts_unique") >= min_unique_ts) & (F.col("count") < strobe))
        | (F.col("total_duration") >= long_connection)
    )
    closed = sni_keys.join(scored.select("hash"), "hash", "left_semi").select("zeek_uid")
    return closed.union(open_sni_keys.select("zeek_uid")).distinct()


def ip_only_keys(conn_keys: DataFrame, uids: DataFrame) -> DataFrame:
    """Pair keys none of whose connections belongs to a scored server-name pair.

    One matching uid rules out the whole key, so the uid match is a semi join on rows and
    the exclusion an anti join on keys.
    """
    used = conn_keys.join(uids, "zeek_uid", "left_semi").select("hash").distinct()
    return conn_keys.select("hash").distinct().join(used, "hash", "left_anti")
