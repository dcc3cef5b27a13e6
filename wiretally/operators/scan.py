"""Port and address scans from connection logs, and scan notices as findings.

The packet-level source of these rules sees TCP events; a log row only has the final
state and the history letters. The mapping below is therefore an approximation: S0 is an
unanswered attempt, REJ a rejected one, and the reset states count when no data flowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.config import ScanConfig

# Connection states that end in a reset, by the side that reset.
_ORIG_RESET = ("RSTO", "RSTOS0")
_RESP_RESET = ("RSTR", "RSTRH")


def scan_roles(conn: DataFrame) -> DataFrame:
    """Failed TCP connections with scanner, victim and probed port.

    The history tells when the responder is really the scanner (a half-open reply seen
    first); then the roles and the port are swapped.
    """
    state = F.col("conn_state")
    history = F.coalesce(F.col("history"), F.lit(""))
    no_data = ~history.rlike("[Dd]")
    failed = (
        state.isin("S0", "REJ")
        | (state.isin(*_ORIG_RESET) & history.contains("S") & no_data)
        | (state.isin(*_RESP_RESET) & no_data)
    )
    reverse = (
        F.when(state == "S0", history.contains("H"))
        .when(state == "REJ", history.contains("s"))
        .when(state.isin(*_RESP_RESET), history.contains("s"))
        .otherwise(F.lit(False))
    )
    return (
        conn.filter((F.col("proto") == "tcp") & failed)
        .withColumn("reverse", reverse)
        .withColumn("scanner", F.when(F.col("reverse"), F.col("dst")).otherwise(F.col("src")))
        .withColumn("victim", F.when(F.col("reverse"), F.col("src")).otherwise(F.col("dst")))
        .withColumn(
            "probed_port", F.when(F.col("reverse"), F.col("src_port")).otherwise(F.col("dst_port"))
        )
    )


def _scans(roles: DataFrame, keys: list[str], counted: str, floor: int, window: str) -> DataFrame:
    # De-duplicating before counting keeps each shuffle row a distinct probe, so a
    # scanner producing a third of all rows spreads over (key, probe).
    probes = roles.select(
        F.window("ts", window).start.alias("window_start"), *keys, counted
    ).distinct()
    return (
        probes.groupBy("window_start", *keys)
        .agg(F.count(F.lit(1)).alias("distinct_probes"))
        .filter(F.col("distinct_probes") >= floor)
    )


def detect_port_scan(conn: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """A scanner probing many ports of one victim within an epoch."""
    return _scans(scan_roles(conn), ["scanner", "victim"], "probed_port", cfg.ports, cfg.window)


def detect_address_scan(conn: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """A scanner probing one port on many hosts within an epoch."""
    return _scans(scan_roles(conn), ["scanner", "probed_port"], "victim", cfg.hosts, cfg.window)


# Notice types raised for scans.
SCAN_NOTES = ("Scan::Port_Scan", "Scan::Address_Scan")


def scan_subtype(note: Column) -> Column:
    return F.when(note == "Scan::Port_Scan", "port_scan").otherwise("address_scan")


def scan_findings(notices: DataFrame) -> DataFrame:
    """Scan notices as reconnaissance findings (class, severity and confidence fixed)."""
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise("unknown")
    count = F.coalesce(F.col("p").cast("string"), F.col("n").cast("string"))
    second = F.coalesce(F.floor("ts").cast("bigint").cast("string"), F.lit("event"))
    return notices.filter(F.col("note").isin(*SCAN_NOTES)).select(
        "ts",
        known("src").alias("source"),
        known("dst").alias("destination"),
        scan_subtype(F.col("note")).alias("subtype"),
        F.concat_ws("_", F.lit("scan"), known("src"), known("dst"), second).alias("flow_id"),
        F.coalesce(count, F.lit("unavailable")).alias("scan_count"),
        F.lit("high").alias("severity"),
        F.lit(0.95).alias("confidence"),
        "msg",
    )
