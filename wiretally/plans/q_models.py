"""Queries over models: evaluation, generated domains, behavioural outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.operators import anomaly, dga, evaluate, flow
from wiretally.plans import adapters as ad
from wiretally.plans.q_detect import labels, words
from wiretally.session import materialise

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = ad.sql(oracle, extra)
        return function

    return register


# A classifier to evaluate: label and score from the order lines.
_C = {
    "judged": """SELECT l_orderkey % 11 AS experiment, CAST(l_returnflag = 'R' AS INTEGER) AS y, (l_quantity + CASE WHEN l_returnflag = 'R' THEN 13 ELSE 0 END) / 64.0 AS score,
      CAST((l_quantity + CASE WHEN l_returnflag = 'R' THEN 13 ELSE 0 END) / 64.0 >= 0.5 AS INTEGER) AS p FROM lineitem""",
    "points": "SELECT score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM judged GROUP BY score",
    "curve": "SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM points",
    "matrix": "SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn FROM judged",
}


def _judged(spark, d):
    hit = F.col("l_returnflag") == "R"
    score = (F.col("l_quantity") + F.when(hit, 13).otherwise(0)) / 64.0
    return ad.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 11).alias("experiment"), hit.cast("int").alias("y"), score.alias("score"), (score >= 0.5).cast("int").alias("p")
    )


@query(
    "a41_evaluate",
    """SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr,
      (SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) FROM curve) AS roc_auc, (SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) FROM curve) AS pr_auc FROM matrix""",
    _C,
)
def evaluate_query(spark, d):
    e = evaluate.evaluate(_judged(spark, d), "y", "p", "score")
    return e.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr", "roc_auc", "pr_auc")])


@query(
    "a41_detection_rate",
    "SELECT experiment, count(*) AS flows, count(*) FILTER (p = 1) AS flagged, round(avg(p), 6) AS detection_rate FROM judged GROUP BY experiment",
    _C,
)
def detection_rate(spark, d):
    r = evaluate.detection_rate(_judged(spark, d), "experiment", "p")
    return r.withColumn("detection_rate", F.round("detection_rate", 6))


# ---- generated domains -------------------------------------------------------------


def _training(spark, d):
    """Digest-like labels are the generated ones."""
    made = ad.table(spark, d, "supplier").select(
        F.substring(F.md5("s_name"), F.lit(1), (F.lit(8) + F.col("s_suppkey") % 9).cast("int")).alias("label")
    ).distinct()
    features = dga.dga_features(labels(spark, d), words(spark, d), dga.fit_bigrams(words(spark, d)))
    marked = features.join(made.withColumn("_made", F.lit(1)), "label", "left")
    return marked.withColumn("label01", F.coalesce("_made", F.lit(0))).drop("_made")


def _model(spark, d):
    """Fit on the digests' first half of the alphabet of their hash, judge on the rest."""
    data = materialise(_training(spark, d), "dga-features")
    held = F.pmod(F.xxhash64("label"), F.lit(10)) < 3
    model = dga.train_dga(data.filter(~held))
    return data, model, dga.predict(data.filter(held), model)


@query("d15_train_dga")
def train_dga(spark, d):
    _, _, judged = _model(spark, d)
    return dga.threshold_sweep(judged).orderBy("threshold")


def dga_findings(spark, d):
    _, model, judged = _model(spark, d)
    threshold = dga.best_threshold(dga.threshold_sweep(judged))
    w = words(spark, d)
    return dga.detect_dga(ad.dns_pages(spark, d), w, dga.fit_bigrams(w), model, threshold)


@query("d16_detect_dga")
def detect_dga(spark, d):
    dns, found = ad.dns_pages(spark, d), dga_findings(spark, d)
    return dns.select("uid", "query").join(found.select("uid", "flow_id", "confidence"), "uid", "left")


@query("a49_dga_detection_rate")
def dga_detection_rate(spark, d):
    _, model, judged = _model(spark, d)
    threshold = dga.best_threshold(dga.threshold_sweep(judged))
    scored = judged.withColumn("dataset", F.when(F.col("label01") == 1, "generated").otherwise("benign"))
    return dga.detection_rate(scored, threshold)


# ---- behavioural outliers ----------------------------------------------------------

_P = {
    "raw_features": """SELECT uid, CASE WHEN proto = 'icmp' THEN 'NaN'::DOUBLE WHEN duration > 300 THEN 'Infinity'::DOUBLE ELSE duration END AS duration, orig_bytes,
      CASE WHEN conn_state = 'REJ' THEN '' ELSE conn_state END AS conn_state, proto FROM conn_events""",
}


def _dirty(spark, d):
    f = flow.flow_features(ad.conn_events(spark, d))
    return f.withColumn(
        "duration",
        F.when(F.col("proto") == "icmp", float("nan")).when(F.col("duration") > 300, float("inf")).otherwise(F.col("duration")),
    ).withColumn("conn_state", F.when(F.col("conn_state") == "REJ", "").otherwise(F.col("conn_state")))


@query(
    "p18_prepare_features",
    """SELECT uid, CASE WHEN isnan(duration) OR isinf(duration) THEN 0 ELSE duration END AS duration, orig_bytes::DOUBLE AS orig_bytes,
      CASE WHEN conn_state = '' THEN 'unknown' ELSE conn_state END AS conn_state, proto FROM raw_features""",
    _P,
)
def prepare_features(spark, d):
    return anomaly.prepare_features(_dirty(spark, d)).select("uid", "duration", "orig_bytes", "conn_state", "proto")


def _forest(spark, d):
    features = anomaly.prepare_features(flow.flow_features(ad.conn_events(spark, d)))
    encoder = anomaly.fit_encoder(features)
    encoded = materialise(anomaly.encode(features, encoder), "anomaly-features")
    benign = encoded.filter(F.col("conn_state") == "SF")
    forest = anomaly.train_forest(benign)
    return encoded, benign, forest


@query("d17_train_anomaly")
def train_anomaly(spark, d):
    _, benign, forest = _forest(spark, d)
    scored = anomaly.score_forest(benign, forest)
    return anomaly.score_range(scored).withColumn("nodes", F.lit(len(forest.nodes)))


@query("d18_detect_anomaly")
def detect_anomaly(spark, d):
    encoded, benign, forest = _forest(spark, d)
    limits = anomaly.score_range(anomaly.score_forest(benign, forest))
    return anomaly.detect_anomaly(anomaly.score_forest(encoded, forest), limits).select("uid", "raw", "confidence")
