"""Queries over scores: beacon maths, threat rows, modifiers, ranked view, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.config import BeaconConfig, ScoreConfig, Thresholds
from wiretally.functions import beaconmath as bm
from wiretally.functions.domains import registrable_domain
from wiretally.functions.formats import severity_band
from wiretally.operators import beacons, findings, hourly, linking, rollups, scoring
from wiretally.operators.alerts import make_alerts
from wiretally.plans import adapters as ad
from wiretally.plans import q_hourly as qh
from wiretally.plans import q_logs as ql
from wiretally.plans.logs import SQL, RecentLogs, stored_logs
from wiretally.session import materialise, release

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_LONG = Thresholds(3600, 14400, 28800, 43200)
CFG = ScoreConfig(subdomains=Thresholds(10, 20, 40, 80), rolling=True)
IMPORT_ID = "import-1"


def query(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = ad.sql(oracle, {**_ALL, **(extra or {})})
        return function

    return register


# ---- beacon maths in SQL -----------------------------------------------------------


def _med(x: str) -> str:
    return f"(({x})[(len({x}) + 1) // 2] + ({x})[len({x}) // 2 + 1]) / 2.0"


def _low(x: str) -> str:
    return f"{x}[1:len({x}) // 2]"


def _high(x: str) -> str:
    return f"{x}[(len({x}) + 1) // 2 + 1:]"


def _skew(q1: str, q2: str, q3: str) -> str:
    return f"CASE WHEN {q3} - {q1} >= 10 AND {q2} <> {q1} AND {q2} <> {q3} THEN ({q1} + {q3} - 2 * {q2}) / ({q3} - {q1}) ELSE 0.0 END"


def _madscore(m: str, mad: str, default: str) -> str:
    return f"greatest(CASE WHEN {m} >= 1 THEN ({m} - {mad}) / {m} ELSE {default} END, 0.0)"


def bucket_sql(v: str, t: Thresholds) -> str:
    def part(lo, hi, a, b):
        return f"{a} + (least({v}, {hi}) - {lo}) / ({hi}.0 - {lo}.0) * ({b} - {a})"

    return (
        f"CASE WHEN {v} < {t.base} THEN 0.0 WHEN {v} < {t.low} THEN {part(t.base, t.low, 0.2, 0.4)} "
        f"WHEN {v} < {t.medium} THEN {part(t.low, t.medium, 0.4, 0.6)} ELSE {part(t.medium, t.high, 0.6, 0.8)} END"
    )


def beacon_sql(p: str, rows: str, totals: str) -> dict[str, str]:
    """CTEs that end in ``{p}_beacon`` for connections ``rows`` (hash, ts, src_ip_bytes)."""
    return {
        f"{p}_el": f"SELECT hash FROM {totals} WHERE ts_unique >= 4 AND count < 86400",
        f"{p}_sec": f"SELECT r.hash, epoch(ts)::BIGINT AS t, count(*) AS n FROM {rows} r JOIN {p}_el e ON r.hash = e.hash GROUP BY ALL",
        f"{p}_gap": f"SELECT hash, t, n, t - lag(t) OVER (PARTITION BY hash ORDER BY t) AS g FROM {p}_sec",
        f"{p}_time": f"SELECT hash, list(g ORDER BY g) FILTER (g IS NOT NULL) AS gaps, min(t) AS t0, max(t) AS t1 FROM {p}_gap GROUP BY hash",
        f"{p}_size": f"SELECT r.hash, list(src_ip_bytes ORDER BY src_ip_bytes) AS sizes FROM {rows} r JOIN {p}_el e ON r.hash = e.hash GROUP BY r.hash",
        f"{p}_lim": "SELECT epoch(min_ts)::BIGINT AS lo, epoch(max_ts)::BIGINT AS hi FROM beacon_span",
        f"{p}_bar": f"""SELECT hash, CAST(least(greatest(floor((t - lo) / ((hi - lo) / 24.0)), 0), 23) AS INTEGER) AS b, CAST(sum(n) AS BIGINT) AS n
          FROM {p}_sec CROSS JOIN {p}_lim GROUP BY ALL""",
        f"{p}_hist": f"""SELECT k.hash, list(coalesce(n, 0) ORDER BY g.b) AS hist FROM (SELECT DISTINCT hash FROM {p}_bar) k
          CROSS JOIN (SELECT CAST(unnest(range(24)) AS INTEGER) AS b) g LEFT JOIN {p}_bar c ON c.hash = k.hash AND c.b = g.b GROUP BY k.hash""",
        f"{p}_q": f"""SELECT t.hash, gaps, sizes, hist, t0, t1, lo, hi, {_med(_low('gaps'))} AS q1, {_med('gaps')} AS q2, {_med(_high('gaps'))} AS q3,
            {_med(_low('sizes'))} AS s1, {_med('sizes')} AS s2, {_med(_high('sizes'))} AS s3,
            len(list_filter(hist, lambda x: x > 0)) AS bars, ceil(list_max(hist) * 0.05) AS width,
            array_to_string(list_transform(hist, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS shape
          FROM {p}_time t JOIN {p}_size s ON t.hash = s.hash JOIN {p}_hist h ON h.hash = t.hash CROSS JOIN {p}_lim WHERE len(gaps) >= 3 AND len(sizes) >= 3""",
        f"{p}_m": f"""SELECT *, {_med("list_sort(list_transform(gaps, lambda x: abs(x - q2)))")} AS tmad, {_med("list_sort(list_transform(sizes, lambda x: abs(x - s2)))")} AS smad,
            {_skew('q1', 'q2', 'q3')} AS tskew, {_skew('s1', 's2', 's3')} AS sskew,
            least(24, list_max(list_transform(string_split(shape || shape, '0'), lambda x: len(x)))) AS run,
            list_aggregate(hist, 'stddev_pop') / list_aggregate(hist, 'avg') AS cv,
            list_transform(list_filter(hist, lambda x: x > 0), lambda x: CAST(floor(x / width) * width AS INTEGER)) AS grp FROM {p}_q""",
        f"{p}_f": f"""SELECT *, list_sort(list_transform(list_distinct(grp), lambda v: len(list_filter(grp, lambda x: x = v))), 'DESC') AS freq FROM {p}_m""",
        f"{p}_s": f"""SELECT *, round((1 - abs(tskew) + {_madscore('q2', 'tmad', '1.0')}) / 2, 3) AS ts_score,
            round((1 - abs(sskew) + {_madscore('s2', 'smad', '0.0')}) / 2, 3) AS ds_score,
            CASE WHEN cv > 1 THEN 0.0 ELSE least(round(1 - cv, 3), 1.0) END AS cv_score,
            CASE WHEN bars >= 11 THEN least(round((freq[1] + coalesce(freq[2], 0)) / greatest(bars - 1, 1)::DOUBLE, 3), 1.0) ELSE 0.0 END AS bimodal_score,
            CASE WHEN bars >= 6 THEN greatest(least(ceil((t1 - t0) / (hi - lo)::DOUBLE * 1000) / 1000.0, 1.0), least(ceil(run / 12.0::DOUBLE * 1000) / 1000.0, 1.0)) ELSE 0.0 END AS dur_score FROM {p}_f""",
        f"{p}_beacon": f"""SELECT *, greatest(cv_score, bimodal_score) AS hist_score,
            round((ts_score::DECIMAL(6,3) + ds_score::DECIMAL(6,3) + dur_score::DECIMAL(6,3) + greatest(cv_score, bimodal_score)::DECIMAL(6,3)) * 0.25, 3)::DOUBLE AS beacon_score FROM {p}_s""",
    }


_REAL = {"real_conn": "SELECT hash, ts, src_ip_bytes FROM conn WHERE NOT missing_host_header"}
_ALL = {
    **SQL,
    **qh.ROLLUPS,
    **qh.MIN_MAX,
    **qh.SIZE,
    **qh.PREVALENCE,
    **qh.FIRST_SEEN,
    **qh.DIRECT,
    **qh.SIGNATURES,
    **qh.MIME,
    **qh._PORT,
    **qh._LABELS,
    **ql._UIDS,
    **_REAL,
    **beacon_sql("ip", "real_conn", "ip_roll"),
    **beacon_sql("sni", "sni_rows", "sni_roll"),
}


def ip_span(logs):
    return hourly.analysis_range(qh.min_max(logs), beacon_only=True)


def ip_features(logs):
    totals = qh.rollup_ip(logs)
    return beacons.beacon_features(
        hourly.pair_seconds(logs.conn), hourly.pair_sizes(logs.conn), beacons.eligible_keys(totals), ip_span(logs)
    )


def _ints(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


def _ints_sql(column: str) -> str:
    return f"array_to_string({column}, ',') AS {column}"


@query("w02_deltas", f"SELECT hash, {_ints_sql('gaps')} FROM ip_time")
def deltas(spark, d):
    """Gaps as text; a key left by the strobe rule has fewer than 86,400."""
    logs = stored_logs(spark, d)
    keys = beacons.eligible_keys(qh.rollup_ip(logs))
    gaps = beacons.gap_counts(beacons.key_seconds(hourly.pair_seconds(logs.conn).join(keys, "hash", "left_semi")))
    pairs = gaps.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("gap", "n"))).alias("pairs"))
    repeated = F.flatten(F.transform("pairs", lambda p: F.array_repeat(p["gap"], p["n"].cast("int"))))
    return pairs.select("hash", repeated.alias("gaps")).select("hash", _ints("gaps"))


@query("b06_ts_histogram", f"SELECT hash, {_ints_sql('hist')} FROM ip_hist")
def histogram(spark, d):
    return ip_features(stored_logs(spark, d)).select("hash", _ints("hist"))


@query(
    "b01_quartiles_bowley",
    "SELECT hash, q1, q2, q3, s1, s2, s3, round(tskew, 8) AS ts_skew, round(sskew, 8) AS ds_skew FROM ip_m",
)
def quartiles(spark, d):
    f = ip_features(stored_logs(spark, d)).filter("gap_count >= 3 AND size_count >= 3")
    q, s = [f"gap_q{i}" for i in (1, 2, 3)], [f"size_q{i}" for i in (1, 2, 3)]
    skew = lambda c: F.round(bm.bowley_skew(*map(F.col, c)), 8)
    return f.select(
        "hash",
        *[F.col(c).alias(c.replace("gap_", "")) for c in q],
        *[F.col(c).alias(c.replace("size_q", "s")) for c in s],
        skew(q).alias("ts_skew"),
        skew(s).alias("ds_skew"),
    )


_PARTS = {
    "b02_mad_score": ("tmad AS ts_mad, smad AS ds_mad", ("ts_mad", "ds_mad")),
    "b03_ts_score": ("ts_score", ("ts_score",)),
    "b04_ds_score": ("ds_score", ("ds_score",)),
    "b08_cv_score": ("cv_score", ("cv_score",)),
    "b09_bimodal_score": ("bimodal_score", ("bimodal_score",)),
    "b10_hist_score": ("hist_score", ("hist_score",)),
    "b11_dur_score": ("dur_score", ("dur_score",)),
    "w04_longest_run": ("bars AS total_bars, run AS longest_run", ("total_bars", "longest_run")),
}


def _part(columns: tuple[str, ...]):
    def run(spark, d):
        return beacons.score_beacons(ip_features(stored_logs(spark, d))).select("hash", *columns)

    return run


for _name, (_select, _columns) in _PARTS.items():
    query(_name, f"SELECT hash, {_select} FROM ip_beacon")(_part(_columns))


@query("b07_freq_counts", f"SELECT hash, {_ints_sql('freq')} FROM ip_f")
def freq_counts(spark, d):
    f = ip_features(stored_logs(spark, d)).filter("gap_count >= 3 AND size_count >= 3")
    counts = bm.frequency_counts(bm.frequency_groups(F.col("hist"), 0.05))
    return f.withColumn("freq", counts).select("hash", _ints("freq"))


@query("b12_beacon_score_ip", "SELECT hash, beacon_score, ts_score, ds_score, hist_score, dur_score FROM ip_beacon")
def beacon_ip(spark, d):
    return beacons.score_beacons(ip_features(stored_logs(spark, d))).select(
        "hash", "beacon_score", "ts_score", "ds_score", "hist_score", "dur_score"
    )


@query("b12_beacon_score_sni", "SELECT hash, beacon_score, ts_score, ds_score, hist_score, dur_score FROM sni_beacon")
def beacon_sni(spark, d):
    logs = stored_logs(spark, d)
    scored = sni_beacons(logs, qh.rollup_sni(logs), scored_only=True)
    return scored.select("hash", "beacon_score", "ts_score", "ds_score", "hist_score", "dur_score")


def sni_beacons(logs, totals, scored_only=False, span=None):
    span = ip_span(logs) if span is None else span
    seconds, sizes = hourly.pair_seconds(logs.sni_rows), hourly.pair_sizes(logs.sni_rows)
    return beacons.score_keys(totals, seconds, sizes, span, scored_only=scored_only)


@query(
    "b05_distinct_counts",
    "SELECT hash, g AS gap, count(*) AS n FROM ip_gap WHERE g IS NOT NULL GROUP BY ALL UNION ALL SELECT hash, 0, sum(n - 1)::BIGINT FROM ip_sec GROUP BY hash HAVING sum(n - 1) > 0",
)
def distinct_counts(spark, d):
    logs = stored_logs(spark, d)
    keys = beacons.eligible_keys(qh.rollup_ip(logs))
    seconds = hourly.pair_seconds(logs.conn).join(keys, "hash", "left_semi")
    return beacons.interval_counts(seconds)


@query(
    "b05_mode",
    """SELECT hash, arg_min(src_ip_bytes, (-n, src_ip_bytes)) AS mode, max(n) AS mode_count FROM (SELECT hash, src_ip_bytes, count(*) AS n FROM real_conn GROUP BY ALL) GROUP BY hash""",
)
def mode(spark, d):
    real = stored_logs(spark, d).conn.filter(~F.col("missing_host_header"))
    return beacons.mode_of(beacons.value_counts(real, ["hash"], "src_ip_bytes"), ["hash"], "src_ip_bytes")


@query(
    "b13_bucket_score",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({bucket_sql('l_extendedprice', _LONG)}, 8) AS score FROM lineitem",
)
def bucketed(spark, d):
    lines = ad.table(spark, d, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(bm.bucket_score(F.col("l_extendedprice"), _LONG), 8).alias("score")
    )


@query(
    "p23_severity_band",
    """SELECT event_id, CASE WHEN round(value / 500, 9) > 0.8 THEN 'critical' WHEN round(value / 500, 9) >= 0.6 THEN 'high' WHEN round(value / 500, 9) >= 0.4 THEN 'medium'
      WHEN round(value / 500, 9) >= 0.2 THEN 'low' ELSE 'none' END AS band FROM events""",
)
def band(spark, d):
    return ad.table(spark, d, "events").select("event_id", severity_band(F.col("value") / 500).alias("band"))


# ---- threat rows -------------------------------------------------------------------


def scored_rows(logs, seen=None):
    """All threat rows of the last 24 hours of the import with their row modifiers.

    Only first sights (``seen``, where an import keeps them) and the size of the network come
    from the whole import.
    """
    size, span = qh.size(logs), ip_span(logs)
    seen = qh.first_seen(logs) if seen is None else seen
    start = span.select("min_ts").first()[0]
    if start is not None:
        logs = RecentLogs(logs, start)
    for name in ("uconn", "usni", "udns", "sni_rows"):  # hourly tables: written once, read by many
        logs.__dict__[name] = materialise(getattr(logs, name), name)
    span, size = materialise(span, "span"), materialise(size, "size")
    release(logs.spark)  # shuffle files of the import
    keys = linking.ip_only_keys(ql.pair_keys(logs), ql.sni_uids(logs))
    ip = qh.rollup_ip(logs, keys)
    ip = beacons.score_keys(ip, hourly.pair_seconds(logs.conn), hourly.pair_sizes(logs.conn), span)
    ip = materialise(ip, "ip-rollup")
    ip = rollups.attach_intel(ip, logs.intel, "target_ip", "ip")
    ip = rollups.attach_prevalence(ip, rollups.prevalence_ip([logs.uconn, logs.open_conn]), "target_ip", "ip", size)
    ip = rollups.attach_first_seen(ip, seen, "target_ip", "ip", True)
    ip = rollups.attach_ports(ip, qh.labels(logs))

    sni = materialise(sni_beacons(logs, qh.rollup_sni(logs), span=span), "sni-rollup")
    release(logs.spark)
    sni = rollups.attach_intel(sni, logs.intel, "fqdn", "fqdn")
    counts = rollups.prevalence_fqdn(qh.named(logs) + [(logs.udns, "fqdn")])
    sni = rollups.attach_prevalence(sni, counts, "fqdn", "fqdn", size)
    sni = rollups.attach_first_seen(sni, seen, "fqdn", "fqdn", True)
    sni = rollups.attach_ports(sni, qh.labels(logs))

    dns = qh.rollup_dns(logs).join(qh.direct_flag(logs), "tld", "left")
    dns = dns.withColumn("no_direct_conn", F.coalesce("no_direct_conn", F.lit(False)))
    listed = logs.intel.withColumn("tld", registrable_domain("fqdn"))
    dns = rollups.attach_intel(dns, listed, "tld", "tld")
    dns = rollups.attach_prevalence(dns, rollups.prevalence_tld(qh.named(logs), logs.udns), "tld", "tld", size)
    dns = rollups.attach_first_seen(dns, seen, "tld", "fqdn", False)

    rows = scoring.score_threats(ip, sni, dns, CFG).crossJoin(F.broadcast(span.select(F.col("max_ts").alias("_now"))))
    return scoring.row_modifiers(rows, CFG, F.col("_now")).drop("_now").withColumn("import_id", F.lit(IMPORT_ID))


_stored_scores: dict = {}


def stored_scores(spark, d):
    """Threat rows written once, like the result table of an import."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored_scores:
        _stored_scores[key] = materialise(scored_rows(stored_logs(spark, d)), "scores")
        release(spark)
    return _stored_scores[key]


_PREV_SCORE = "CASE WHEN prevalence <= 0.02 THEN 0.15 WHEN prevalence >= 0.5 THEN -0.15 ELSE 0.0 END"
_AGE_SCORE = "CASE WHEN age / 86400.0 <= 7 THEN 0.15 WHEN age / 86400.0 >= 30 THEN -0.15 ELSE 0.0 END"
_NET = "(SELECT count(*) FROM hosts)"
_NOW = "(SELECT epoch(max_ts)::BIGINT FROM beacon_span)"
_ALL.update(
    {
        "only_ip": """SELECT k.hash FROM (SELECT hash, zeek_uid FROM conn UNION SELECT hash, zeek_uid FROM open_conn) k LEFT JOIN used_uids u ON k.zeek_uid = u.zeek_uid GROUP BY k.hash HAVING count(u.zeek_uid) = 0""",
        "ports": "SELECT hash, array_to_string(list_sort(list(label)), ',') AS ports FROM labels_all GROUP BY hash",
        "t_ip": f"""SELECT r.hash, 'ip' AS beacon_type, src, src_nuid, dst, dst_nuid, '' AS fqdn, count, total_duration, total_bytes, missing_host_count, 0 AS subdomain_count, beacon_score,
            EXISTS (SELECT 1 FROM intel i WHERE i.ip = target_ip AND i.ip <> '') AS listed, coalesce(prevalence_total, 0) AS prevalence_total, false AS quiet,
            r.last_seen, f.first_seen AS fsh, coalesce(ports, '') AS ports
          FROM ip_roll r JOIN only_ip USING (hash) LEFT JOIN ip_beacon b ON b.hash = r.hash LEFT JOIN prev_ip p ON p.ip = target_ip
          LEFT JOIN first_seen f ON f.ip = target_ip LEFT JOIN ports o ON o.hash = r.hash""",
        "t_sni": f"""SELECT r.hash, 'sni' AS beacon_type, src, src_nuid, '' AS dst, '' AS dst_nuid, r.fqdn, count, total_duration, total_bytes, 0 AS missing_host_count, 0 AS subdomain_count, beacon_score,
            EXISTS (SELECT 1 FROM intel i WHERE i.fqdn = r.fqdn AND i.fqdn <> '') AS listed, coalesce(prevalence_total, 0) AS prevalence_total, false AS quiet,
            r.last_seen, f.first_seen AS fsh, coalesce(ports, '') AS ports
          FROM sni_roll r LEFT JOIN sni_beacon b ON b.hash = r.hash LEFT JOIN prev_fqdn p ON p.fqdn = r.fqdn
          LEFT JOIN first_seen f ON f.fqdn = r.fqdn LEFT JOIN ports o ON o.hash = r.hash""",
        "t_dns": f"""SELECT md5(r.tld) AS hash, 'dns' AS beacon_type, '' AS src, '' AS src_nuid, '' AS dst, '' AS dst_nuid, r.tld AS fqdn, 0 AS count, 0.0 AS total_duration, 0 AS total_bytes, 0 AS missing_host_count,
            subdomain_count, NULL AS beacon_score, EXISTS (SELECT 1 FROM intel i WHERE i.fqdn <> '' AND {ad.tld_sql('i.fqdn')} = r.tld) AS listed,
            coalesce(prevalence_total, 0) AS prevalence_total, coalesce(no_direct_conn, false) AS quiet, r.last_seen, r.first_seen AS fsh, '' AS ports
          FROM dns_roll r LEFT JOIN prev_tld p ON p.tld = r.tld LEFT JOIN direct_flag g ON g.tld = r.tld""",
        "t_all": f"""SELECT *, prevalence_total / {_NET} AS prevalence, {_NOW} - epoch(fsh)::BIGINT AS age,
            CASE WHEN beacon_score IS NULL THEN 0.0 ELSE {bucket_sql('beacon_score * 100', CFG.beacon.thresholds)} END AS beacon_threat_score,
            CASE WHEN beacon_type = 'dns' THEN 0.0 ELSE {bucket_sql('total_duration', _LONG)} END AS long_conn_score,
            CASE WHEN count >= 86400 THEN 0.6 + 0.2 ELSE 0.0 END AS strobe_score,
            CASE WHEN beacon_type = 'dns' THEN {bucket_sql('subdomain_count', CFG.subdomains)} ELSE 0.0 END AS c2_over_dns_score
          FROM (SELECT * FROM t_ip UNION ALL SELECT * FROM t_sni UNION ALL SELECT * FROM t_dns)
          WHERE beacon_type = 'dns' OR beacon_score IS NOT NULL OR total_duration >= 3600 OR count >= 86400""",
        "threats": f"""SELECT *, CASE WHEN listed THEN 0.8 ELSE 0.0 END AS threat_intel_score,
            CASE WHEN beacon_type <> 'dns' AND missing_host_count > 0 THEN 0.1 ELSE 0.0 END AS missing_host_score,
            CASE WHEN beacon_type <> 'dns' AND listed AND total_bytes >= 25000000 THEN 0.15 ELSE 0.0 END AS intel_size_score,
            CASE WHEN beacon_type = 'dns' AND quiet THEN 0.15 ELSE 0.0 END AS c2_direct_score,
            {_PREV_SCORE} AS prevalence_score, {_AGE_SCORE} AS first_seen_score FROM t_all""",
    }
)

_SCORES = ("beacon_threat_score", "long_conn_score", "strobe_score", "c2_over_dns_score")
_MODS = ("threat_intel_score", "missing_host_score", "intel_size_score", "c2_direct_score", "prevalence_score", "first_seen_score")


def _rounded(columns):
    return [F.round(c, 6).alias(c) for c in columns]


def _rounded_sql(columns) -> str:
    return ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in columns)


@query("b14_score_threats", f"SELECT hash, beacon_type, fqdn, count, subdomain_count, coalesce(beacon_score, 0) AS beacon_score, {_rounded_sql(_SCORES)} FROM threats")
def score_threats(spark, d):
    return stored_scores(spark, d).select("hash", "beacon_type", "fqdn", "count", "subdomain_count", "beacon_score", *_rounded(_SCORES))


@query("b15_row_modifiers", f"SELECT hash, prevalence_total, {_rounded_sql(_MODS + ('prevalence',))} FROM threats")
def row_modifiers(spark, d):
    return stored_scores(spark, d).select("hash", "prevalence_total", *_rounded(_MODS + ("prevalence",)))


_ALL.update(
    {
        "sig_totals": """SELECT src, src_nuid, signature, count(DISTINCT used_dst) AS times_used_dst, count(DISTINCT fqdn) FILTER (fqdn <> '') AS times_used_fqdn
          FROM uses GROUP BY ALL HAVING count(DISTINCT used_dst) = 1 OR count(DISTINCT fqdn) FILTER (fqdn <> '') = 1""",
        "rare": """SELECT DISTINCT u.src, u.src_nuid, u.dst, u.dst_nuid, u.fqdn, u.signature, times_used_dst, times_used_fqdn FROM uses u
          JOIN sig_totals t ON u.src = t.src AND u.src_nuid = t.src_nuid AND u.signature = t.signature
          WHERE CASE WHEN u.fqdn <> '' THEN times_used_fqdn = 1 ELSE times_used_dst = 1 END""",
        "mods": """SELECT t.hash, t.fqdn, 'rare_signature' AS modifier_name, min(r.signature) AS modifier_value, 0.15 AS modifier_score FROM threats t
            JOIN rare r ON t.src = r.src AND t.src_nuid = r.src_nuid AND t.dst = r.dst AND t.dst_nuid = r.dst_nuid AND t.fqdn = r.fqdn GROUP BY t.hash, t.fqdn
          UNION ALL SELECT t.hash, t.fqdn, 'mime_type_mismatch', CAST(m.n AS VARCHAR), 0.15 FROM threats t JOIN (SELECT hash, count(*) AS n FROM mismatched GROUP BY hash) m ON m.hash = t.hash""",
    }
)


def rare(logs):
    uses = hourly.signature_uses(logs.unstored.http, logs.ssl, logs.conn)
    return scoring.rare_signatures(materialise(uses, "signature-uses"))


@query("b16_rare_signatures", "SELECT src, dst, fqdn, signature, times_used_dst, times_used_fqdn FROM rare")
def rare_query(spark, d):
    return rare(stored_logs(spark, d)).select("src", "dst", "fqdn", "signature", "times_used_dst", "times_used_fqdn")


def modifiers(spark, d):
    # Scores first: they store the requests, which are then not linked again.
    logs, scores = stored_logs(spark, d), stored_scores(spark, d)
    mime = hourly.count_mime_mismatches(logs.unstored.http, ad.valid_mime(spark))
    return scoring.modifier_rows(scores, rare(logs), mime, CFG)


@query("j12_rare_signature_rows", "SELECT hash, fqdn, modifier_value FROM mods WHERE modifier_name = 'rare_signature'")
def rare_rows(spark, d):
    m = scoring.modifier_rows(stored_scores(spark, d), rare(stored_logs(spark, d)), None, CFG)
    return m.select("hash", "fqdn", "modifier_value")


@query("j13_mime_rows", "SELECT hash, fqdn, modifier_value FROM mods WHERE modifier_name = 'mime_type_mismatch'")
def mime_rows(spark, d):
    mime = hourly.count_mime_mismatches(stored_logs(spark, d).http, ad.valid_mime(spark))
    return scoring.modifier_rows(stored_scores(spark, d), None, mime, CFG).select("hash", "fqdn", "modifier_value")


@query("b16_modifier_rows", "SELECT hash, modifier_name, modifier_value, 0.15::DOUBLE AS modifier_score FROM mods")
def modifier_rows(spark, d):
    return modifiers(spark, d).select("hash", "modifier_name", "modifier_value", "modifier_score")


_ALL["view"] = """SELECT *, base + ms + prevalence_score + first_seen_score + missing_host_score + intel_size_score + c2_direct_score AS final_score FROM (
    SELECT t.*, coalesce(ms, 0.0) AS ms, coalesce(mods_text, '') AS modifiers, greatest(beacon_threat_score, long_conn_score, strobe_score, c2_over_dns_score, threat_intel_score) AS base
    FROM threats t LEFT JOIN (SELECT hash, sum(modifier_score) AS ms, string_agg(modifier_name || ':' || modifier_value, ',' ORDER BY modifier_name, modifier_value) AS mods_text FROM mods GROUP BY hash) m ON m.hash = t.hash)"""
_BAND = "CASE WHEN round({0}::DOUBLE, 9) > 0.8 THEN 'critical' WHEN round({0}::DOUBLE, 9) >= 0.6 THEN 'high' WHEN round({0}::DOUBLE, 9) >= 0.4 THEN 'medium' WHEN round({0}::DOUBLE, 9) >= 0.2 THEN 'low' ELSE 'none' END"
_VIEW = f"hash, src, dst, fqdn, count, total_bytes, round(final_score::DOUBLE, 6) AS final_score, round(base::DOUBLE, 6) AS base_score, modifiers, {_BAND.format('final_score')} AS severity, ports"


def view(spark, d):
    return scoring.results_view(stored_scores(spark, d), modifiers(spark, d))


def _shown(v):
    text = F.coalesce(F.array_join(F.transform("modifiers", lambda m: F.concat(m["name"], F.lit(":"), m["value"])), ","), F.lit(""))
    return v.select(
        *("hash", "src", "dst", "fqdn", "count", "total_bytes", "severity"),
        *_rounded(("final_score", "base_score")),
        text.alias("modifiers"),
        F.array_join("port_proto_service", ",").alias("ports"),
    )


@query("a23_results_view", f"SELECT {_VIEW} FROM view")
def results_view(spark, d):
    return _shown(scoring.order_results(view(spark, d)))


@query(
    "p22_filter_results",
    f"SELECT {_VIEW} FROM view WHERE src = '10.0.1.3' AND count > 5 AND coalesce(beacon_score, 0) >= 0.4 AND {_BAND.format('final_score')} = 'critical'",
)
def filter_results(spark, d):
    rows = scoring.filter_scored(stored_scores(spark, d), src="10.0.1.3")
    v = scoring.results_view(rows, modifiers(spark, d))
    return _shown(scoring.filter_results(v, count=(">", 5), beacon=(">=", 0.4), severity="critical"))


@query("p22_filter_duration", "SELECT hash, floor(total_duration)::BIGINT AS seconds FROM view WHERE floor(total_duration) = (SELECT max(floor(total_duration)) FROM view) AND NOT listed")
def filter_duration(spark, d):
    rows = scoring.filter_scored(stored_scores(spark, d), threat_intel=False)
    v = scoring.results_view(rows)
    top = scoring.results_view(stored_scores(spark, d)).agg(F.max(F.floor("total_duration")).alias("_top"))
    # The one-row maximum stands in for a user-entered value.
    joined = v.crossJoin(F.broadcast(top))
    return scoring.filter_results(joined, duration=("=", F.col("_top"))).select("hash", F.floor("total_duration").alias("seconds"))


@query("t01_order_results", f"SELECT {_VIEW} FROM view ORDER BY round(final_score::DOUBLE, 6) DESC, strobe_score DESC, beacon_score DESC NULLS LAST, hash")
def order_results(spark, d):
    v = view(spark, d).withColumn("final_score", F.round("final_score", 6))
    return _shown(scoring.order_results(v))


@query(
    "j14_latest_import",
    """SELECT hash, import_id FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY seen DESC, import_id DESC) AS r FROM (
      SELECT md5(src || dst) AS hash, 'import-' || date_trunc('day', ts)::DATE AS import_id, max(ts) AS seen FROM conn_events GROUP BY 1, 2)) WHERE r = 1""",
)
def latest_import(spark, d):
    c = ad.conn_events(spark, d)
    rows = c.groupBy(
        F.md5(F.concat("src", "dst")).alias("hash"), F.concat(F.lit("import-"), F.to_date("ts").cast("string")).alias("import_id")
    ).agg(F.max("ts").alias("last_seen"))
    return scoring.latest_import(rows).select("hash", "import_id")


@query("w06_latest_row", "SELECT src, arg_max(uid, (ts, uid)) AS uid FROM conn_events GROUP BY src")
def latest_row(spark, d):
    return ad.conn_events(spark, d).groupBy("src").agg(F.max_by("uid", F.struct("ts", "uid")).alias("uid"))


# ---- findings ----------------------------------------------------------------------

_AGO = """CASE WHEN age >= 31536000 THEN (age // 31536000) || CASE WHEN age // 31536000 = 1 THEN ' year ago' ELSE ' years ago' END
    WHEN age >= 2592000 THEN (age // 2592000) || CASE WHEN age // 2592000 = 1 THEN ' month ago' ELSE ' months ago' END
    WHEN age >= 86400 THEN (age // 86400) || CASE WHEN age // 86400 = 1 THEN ' day ago' ELSE ' days ago' END
    WHEN age >= 3600 THEN (age // 3600) || CASE WHEN age // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END
    ELSE (age // 60) || CASE WHEN age // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END END"""


def report(spark, d):
    """The findings report, measured from the newest record."""
    span = ip_span(stored_logs(spark, d)).select(F.col("max_ts").alias("_now"))
    return scoring.findings(view(spark, d).crossJoin(F.broadcast(span)), F.col("_now"))


@query(
    "s11_findings_report",
    f"""SELECT upper(substr({_BAND.format('final_score')}, 1, 1)) || substr({_BAND.format('final_score')}, 2) AS severity, src, dst, fqdn, coalesce(beacon_score, 0) AS beacon_score,
      strobe_score > 0 AS strobe, subdomain_count AS subdomains, listed AS threat_intel, missing_host_count > 0 AS missing_host, {_AGO} AS first_seen,
      count AS connections, ports, modifiers FROM view""",
)
def findings_report(spark, d):
    r = report(spark, d)
    names = {
        "Severity": "severity",
        "Source IP": "src",
        "Destination IP": "dst",
        "FQDN": "fqdn",
        "Beacon Score": "beacon_score",
        "Strobe": "strobe",
        "Subdomains": "subdomains",
        "Threat Intel": "threat_intel",
        "Missing Host Header": "missing_host",
        "First Seen": "first_seen",
        "Connection Count": "connections",
        "Port:Proto:Service": "ports",
        "Modifiers": "modifiers",
    }
    return r.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


# Findings shaped like the report, one per part row, with some malformed cells.
_FOUND = {
    "raw_found": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'None' ELSE 'Odd' END AS sev, '10.0.1.' || (o_orderkey % 20 + 1) AS s,
        CASE WHEN o_totalprice < 20000 THEN '' ELSE '198.51.100.' || (o_custkey % 9) END AS t, 'H' || (o_custkey % 5) || '.example.com' AS f,
        CASE WHEN o_totalprice > 450000 THEN 'n/a' ELSE CAST(round(o_totalprice / 500000, 3) AS VARCHAR) END AS score, o_orderpriority = '1-URGENT' AS strobe,
        CASE WHEN o_orderstatus = 'P' THEN '' ELSE (o_custkey % 3 + 80) || ':tcp:' || CASE WHEN o_custkey % 2 = 0 THEN 'http' ELSE '' END || ',443:tcp:ssl' END AS ports,
        CASE WHEN o_orderpriority = '5-LOW' THEN '0.75' WHEN o_orderpriority = '2-HIGH' THEN 'x' ELSE '0' END AS c2 FROM orders""",
    "found": """SELECT *, TRY_CAST(score AS DOUBLE) AS bs, CASE WHEN ports = '' THEN NULL ELSE TRY_CAST(split_part(ports, ':', 1) AS INTEGER) END AS port,
        CASE WHEN ports = '' THEN '' ELSE split_part(split_part(ports, ',', 1), ':', 3) END AS svc FROM raw_found""",
    "typed": """SELECT *, CASE sev WHEN 'High' THEN 'high' WHEN 'None' THEN CASE WHEN bs >= 0.85 THEN 'high' WHEN bs >= 0.7 THEN 'medium' ELSE 'info' END ELSE 'medium' END AS severity,
        'beacon_' || s || '_' || t || '_' || coalesce(CAST(port AS VARCHAR), 'any') || '_' || CASE WHEN svc = '' THEN 'unknown' ELSE svc END AS fp FROM found WHERE t <> '' AND bs IS NOT NULL""",
}


def raw_findings(spark, d):
    o = ad.table(spark, d, "orders")
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    text = lambda x: x.cast("string")
    # Three decimals as the SQL rounds them: the product is rounded, not the shortest decimal text.
    score = F.when(price > 450000, "n/a").otherwise(text(F.round(price / 500000 * 1000) / 1000))
    return o.select(
        k.alias("id"),
        F.when(F.col("o_orderstatus") == "F", "High").when(F.col("o_orderstatus") == "O", "None").otherwise("Odd").alias("Severity"),
        F.concat(F.lit("10.0.1."), text(k % 20 + 1)).alias("Source IP"),
        F.when(price < 20000, "").otherwise(F.concat(F.lit("198.51.100."), text(c % 9))).alias("Destination IP"),
        F.concat(F.lit("H"), text(c % 5), F.lit(".example.com")).alias("FQDN"),
        score.alias("Beacon Score"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "True").otherwise("false").alias("Strobe"),
        F.lit("12.5").alias("Total Duration"),
        F.lit("0").alias("Long Connection Score"),
        F.lit("7").alias("Subdomains"),
        F.when(F.col("o_orderpriority") == "5-LOW", "0.75").when(F.col("o_orderpriority") == "2-HIGH", "x").otherwise("0").alias("C2 Over DNS Score"),
        F.lit("false").alias("Threat Intel"),
        F.lit("0.1").alias("Prevalence"),
        F.lit("2 days ago").alias("First Seen"),
        F.lit("false").alias("Missing Host Header"),
        text(c).alias("Connection Count"),
        F.lit("oops").alias("Total Bytes"),
        F.when(F.col("o_orderstatus") == "P", "")
        .otherwise(
            F.concat(text(c % 3 + 80), F.lit(":tcp:"), F.when(c % 2 == 0, "http").otherwise(""), F.lit(",443:tcp:ssl"))
        )
        .alias("Port:Proto:Service"),
        F.lit("").alias("Modifiers"),
    )


def _beacon_rows(spark, d):
    return findings.beacon_findings(findings.normalize_findings(raw_findings(spark, d)))


@query("p27_normalize_findings", "SELECT fp AS fingerprint, severity, bs AS beacon_score, port AS destination_port, svc AS service, count(*) AS n FROM typed GROUP BY ALL", _FOUND)
def normalize_findings(spark, d):
    return _beacon_rows(spark, d).groupBy("fingerprint", "severity", "beacon_score", "destination_port", "service").agg(F.count(F.lit(1)).alias("n"))


@query("p28_beacon_candidates", "SELECT fp AS fingerprint, count(*) AS n, max(bs) AS top FROM typed WHERE NOT strobe AND bs >= 0.75 GROUP BY fp", _FOUND)
def beacon_candidates(spark, d):
    return findings.beacon_candidates(_beacon_rows(spark, d)).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.max("beacon_score").alias("top")
    )


_TUNNEL = "'c2_over_dns_' || s || '_' || CASE WHEN t = '' THEN 'unknown' ELSE t END || '_' || lower(f)"


@query(
    "p29_tunnel_findings",
    f"SELECT {_TUNNEL} AS fingerprint, CASE sev WHEN 'High' THEN 'high' WHEN 'None' THEN 'info' ELSE 'medium' END AS severity, count(*) AS n FROM raw_found WHERE TRY_CAST(c2 AS DOUBLE) > 0 GROUP BY ALL",
    _FOUND,
)
def tunnel_findings(spark, d):
    t = findings.tunnel_findings(findings.normalize_findings(raw_findings(spark, d)))
    return t.groupBy("fingerprint", "severity").agg(F.count(F.lit(1)).alias("n"))


_SEV = "list_position(['info', 'low', 'medium', 'high', 'critical'], {0})"
_DEDUP = {
    **_FOUND,
    "best": f"SELECT fp, arg_max(bs, (bs, severity)) AS bs, arg_max(severity, (bs, severity)) AS severity FROM typed WHERE NOT strobe GROUP BY fp",
    "prior": """SELECT fp, arg_max(bs, (bs, severity)) AS last_score, arg_max(severity, (bs, severity)) AS last_severity FROM typed WHERE bs < 0.7 AND NOT strobe AND sev <> 'High' GROUP BY fp""",
}


@query(
    "f01_dedup_beacons",
    f"""SELECT b.fp AS fingerprint, bs AS beacon_score, severity, CASE WHEN last_score IS NULL THEN 'new_finding' ELSE 'materially_changed' END AS change_status
    FROM best b LEFT JOIN prior p ON b.fp = p.fp WHERE last_score IS NULL OR {_SEV.format('severity')} > {_SEV.format('last_severity')} OR round(bs - last_score, 9) >= 0.15""",
    _DEDUP,
)
def dedup_beacons(spark, d):
    rows = _beacon_rows(spark, d).filter(~F.col("is_strobe"))
    earlier = rows.filter((F.col("beacon_score") < 0.7) & (F.col("native_severity") != "High"))
    state = earlier.groupBy("fingerprint").agg(F.max(F.struct("beacon_score", "severity")).alias("m")).select(
        "fingerprint", F.col("m.beacon_score").alias("last_score"), F.col("m.severity").alias("last_severity"), F.lit(1).cast("bigint").alias("cycles")
    )
    emitted, _ = findings.dedup_beacons(state, rows)
    return emitted.select("fingerprint", "beacon_score", "severity", "change_status")


@query(
    "f01_dedup_state",
    f"""SELECT fp AS fingerprint, CASE WHEN last_score IS NULL OR {_SEV.format('severity')} > {_SEV.format('last_severity')} OR round(bs - last_score, 9) >= 0.15 THEN bs ELSE last_score END AS last_score,
      CASE WHEN b_null THEN 1 WHEN last_score IS NULL THEN 1 ELSE 2 END AS cycles FROM (
        SELECT coalesce(b.fp, p.fp) AS fp, bs, severity, last_score, last_severity, b.fp IS NULL AS b_null FROM best b FULL JOIN prior p ON b.fp = p.fp)""",
    _DEDUP,
)
def dedup_state(spark, d):
    rows = _beacon_rows(spark, d).filter(~F.col("is_strobe"))
    earlier = rows.filter((F.col("beacon_score") < 0.7) & (F.col("native_severity") != "High"))
    state = earlier.groupBy("fingerprint").agg(F.max(F.struct("beacon_score", "severity")).alias("m")).select(
        "fingerprint", F.col("m.beacon_score").alias("last_score"), F.col("m.severity").alias("last_severity"), F.lit(1).cast("bigint").alias("cycles")
    )
    _, after = findings.dedup_beacons(state, rows)
    return after.select("fingerprint", "last_score", "cycles")


@query(
    "f02_dedup_tunnels",
    f"""SELECT DISTINCT {_TUNNEL} AS fingerprint FROM raw_found WHERE TRY_CAST(c2 AS DOUBLE) > 0
      AND {_TUNNEL} NOT IN (SELECT {_TUNNEL} FROM raw_found WHERE TRY_CAST(c2 AS DOUBLE) > 0 AND sev = 'High')""",
    _FOUND,
)
def dedup_tunnels(spark, d):
    t = findings.tunnel_findings(findings.normalize_findings(raw_findings(spark, d)))
    state = t.filter(F.col("native_severity") == "High").select("fingerprint").distinct()
    fresh, _ = findings.dedup_tunnels(state, t)
    return fresh.select("fingerprint")


def made_beacon_alerts(spark, d):
    rows = findings.as_beacon_alert_rows(findings.beacon_candidates(_beacon_rows(spark, d)))
    return make_alerts(rows.withColumn("ts", F.lit("2024-01-30").cast("timestamp")), "beaconing", "pair_beacons", ["fingerprint", "beacon_score", "connection_count"])


def made_tunnel_alerts(spark, d):
    rows = findings.as_tunnel_alert_rows(findings.tunnel_findings(findings.normalize_findings(raw_findings(spark, d))))
    return make_alerts(rows.withColumn("ts", F.lit("2024-01-30").cast("timestamp")), "dns_tunnel", "dns_tunnels", ["fqdn", "c2_score", "subdomains"])


@query(
    "d19_beacon_alerts",
    """SELECT fp AS flow_id, severity, round_even(least(greatest(bs, 0), 1), 4) AS confidence, s AS source, t AS destination, 'c2_beaconing' AS subtype, 'beaconing' AS threat_class, count(*) AS n
    FROM typed WHERE NOT strobe AND bs >= 0.75 GROUP BY ALL""",
    _FOUND,
)
def beacon_alerts(spark, d):
    made = made_beacon_alerts(spark, d)
    keys = ("flow_id", "severity", "confidence", "source", "destination", "subtype", "threat_class")
    return made.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "d20_tunnel_alerts",
    f"""SELECT {_TUNNEL} AS flow_id, CASE sev WHEN 'High' THEN 'high' WHEN 'None' THEN 'info' ELSE 'medium' END AS severity, 0.75::DOUBLE AS confidence, 'c2_over_dns' AS subtype, 'dns_tunnel' AS threat_class, count(*) AS n
    FROM raw_found WHERE TRY_CAST(c2 AS DOUBLE) > 0 GROUP BY ALL""",
    _FOUND,
)
def tunnel_alerts(spark, d):
    made = made_tunnel_alerts(spark, d)
    return made.groupBy("flow_id", "severity", "confidence", "subtype", "threat_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a48_beacon_experiment_summary",
    """SELECT s AS dataset, count(*) AS findings, count(*) FILTER (NOT strobe AND bs > 0) AS candidates, count(*) FILTER (NOT strobe AND bs > 0 AND bs >= 0.75) AS above_threshold,
      max(bs) AS top_score, arg_max(fp, (bs, fp)) AS top_fingerprint FROM typed GROUP BY s""",
    _FOUND,
)
def beacon_experiments(spark, d):
    return findings.experiment_summary(_beacon_rows(spark, d).withColumn("dataset", F.col("source")))
