"""Models by quality, not by exact numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wiretally.operators import anomaly
from wiretally.plans import q_models

SF = "/root/testdata/sf0.001"


def test_outliers_rank_above_inliers(spark):
    rng = np.random.default_rng(1)
    inside = rng.normal(size=(2000, 4))
    outside = rng.normal(size=(20, 4)) + 9
    rows = [([float(v) for v in x], 0) for x in inside] + [([float(v) for v in x], 1) for x in outside]
    df = spark.createDataFrame(rows, "x array<double>, outlier int")
    forest = anomaly.train_forest(df.filter("outlier = 0"), trees=100)
    scored = anomaly.score_forest(df, forest)
    limit = scored.filter("outlier = 0").agg(F.percentile("raw", 0.99)).first()[0]
    assert scored.filter("outlier = 1").agg(F.min("raw")).first()[0] > limit


def test_generated_domains_are_found(spark):
    sweep = q_models.train_dga(spark, SF).collect()
    assert len(sweep) == 12
    assert max(r.f1 for r in sweep) >= 0.8
