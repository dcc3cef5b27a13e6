"""Behavioural outliers: feature preparation, isolation forest, scoring.

Spark ML has no isolation forest. Trees are grown in parallel, one group of about 256
sampled rows per tree; the forest is then a table of at most trees x 511 nodes, a size
fixed by the parameters, and scoring is a vectorised walk over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the feature vector, in order.
NUMERIC = (
    "duration",
    "orig_bytes",
    "resp_bytes",
    "orig_pkts",
    "resp_pkts",
    "orig_ip_bytes",
    "resp_ip_bytes",
    "total_bytes",
    "total_pkts",
    "byte_rate",
    "packet_rate",
    "byte_ratio",
    "packet_ratio",
    "missed_bytes",
)
CATEGORICAL = ("proto", "conn_state")
# Alert limits.
RAW_LIMIT = -0.05
CONFIDENCE_LIMIT = 0.25

_NODES = "tree int, node int, feature int, split double, left int, right int, depth double"


def prepare_features(df: DataFrame) -> DataFrame:
    """Numbers without NaN or infinity, categories without NULL, fixed column order."""
    missing = [c for c in NUMERIC + CATEGORICAL if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")
    rest = [c for c in df.columns if c not in NUMERIC + CATEGORICAL]
    number = lambda c: F.col(c).try_cast("double")
    finite = lambda c: F.when(
        number(c).isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf")), 0.0
    ).otherwise(number(c))
    known = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", "unknown").otherwise(F.col(c))
    return df.select(
        *rest, *[finite(c).alias(c) for c in NUMERIC], *[known(c).alias(c) for c in CATEGORICAL]
    )


def fit_encoder(features: DataFrame) -> PipelineModel:
    """Scaled numbers and one-hot categories; unseen categories get their own slot."""
    numbers = VectorAssembler(inputCols=list(NUMERIC), outputCol="_numbers")
    scaler = StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True)
    index = StringIndexer(
        inputCols=list(CATEGORICAL), outputCols=[f"_{c}_i" for c in CATEGORICAL], handleInvalid="keep"
    )
    hot = OneHotEncoder(
        inputCols=[f"_{c}_i" for c in CATEGORICAL],
        outputCols=[f"_{c}_v" for c in CATEGORICAL],
        handleInvalid="keep",
        dropLast=False,
    )
    both = VectorAssembler(inputCols=["_scaled", *[f"_{c}_v" for c in CATEGORICAL]], outputCol="_vector")
    return Pipeline(stages=[numbers, scaler, index, hot, both]).fit(features)


def encode(features: DataFrame, encoder: PipelineModel) -> DataFrame:
    out = encoder.transform(features).withColumn("x", vector_to_array("_vector"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Random splits down to single points or the height limit, as node rows."""
    rows: list[tuple] = []
    stack = [(0, np.arange(len(x)), 0)]
    count = 1
    while stack:
        node, members, depth = stack.pop()
        part = x[members]
        span = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(members) > 1 else ()
        if depth >= limit or len(span) == 0:
            rows.append((node, -1, 0.0, -1, -1, depth + average_path(len(members))))
            continue
        feature = int(rng.choice(span))
        column = part[:, feature]
        split = float(rng.uniform(column.min(), column.max()))
        below = column <= split
        rows.append((node, feature, split, count, count + 1, float(depth)))
        stack += [(count, members[below], depth + 1), (count + 1, members[~below], depth + 1)]
        count += 2
    return rows


@dataclass
class Forest:
    """Node table on the driver (trees x 511 rows at most) and the sample size."""

    nodes: pd.DataFrame
    sample: int


def _sampled(encoded: DataFrame, trees: int, sample: int, total: int, seed: int) -> DataFrame:
    """(tree, x) rows, about ``sample`` per tree: every tree draws from all rows, independently.

    The draw is a hash of the whole row and the tree, so only drawn rows are ever written out, and
    the same rows are drawn at any number and order of partitions. Rows that are equal in all
    columns are drawn together or not at all; carry an id where that matters.
    """
    share = min(1.0, sample / max(total, 1))
    limit = int(share * 2**62)
    drawn = lambda t: F.shiftrightunsigned(F.xxhash64("_draw", t), 2) <= limit
    own = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), drawn)
    row = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in sorted(encoded.columns)])
    return encoded.select(row.alias("_draw"), "x").select(F.explode(own).alias("tree"), "x")


def train_forest(encoded: DataFrame, trees: int = 300, sample: int = 256, seed: int = 42) -> Forest:
    """Isolation forest over the column ``x``."""
    total = encoded.count()
    limit = int(np.ceil(np.log2(max(min(sample, total), 2))))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rng = np.random.default_rng(seed + tree)
        x = np.stack(pdf.x.to_numpy()).astype("float64")
        rows = grow_tree(x[np.lexsort(x.T[::-1])], rng, limit)
        out = pd.DataFrame(rows, columns=["node", "feature", "split", "left", "right", "depth"])
        out.insert(0, "tree", tree)
        return out

    nodes = _sampled(encoded, trees, sample, total, seed).groupBy("tree").applyInPandas(grow, _NODES)
    return Forest(nodes.toPandas(), min(sample, total))


def score_forest(encoded: DataFrame, forest: Forest) -> DataFrame:
    """Add ``raw``: 2^(-mean path / expected path) - 0.5, higher is more unusual."""
    expected = average_path(forest.sample)
    trees = []
    for _, part in forest.nodes.sort_values(["tree", "node"]).groupby("tree"):
        trees.append(tuple(part[c].to_numpy() for c in ("feature", "split", "left", "right", "depth")))
    shared = encoded.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def path(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype="float64")
                continue
            x = np.stack(batch.to_numpy())
            rows = np.arange(len(x))
            lengths = np.zeros(len(x))
            for feature, split, left, right, depth in model:
                at = np.zeros(len(x), dtype=np.int64)
                active = feature[at] >= 0
                while active.any():
                    here, who = at[active], rows[active]
                    low = x[who, feature[here]] <= split[here]
                    at[active] = np.where(low, left[here], right[here])
                    active = feature[at] >= 0
                lengths += depth[at]
            yield pd.Series(lengths / len(model))

    return encoded.withColumn("raw", F.pow(F.lit(2.0), -path("x") / F.lit(expected)) - 0.5)


def score_range(scored: DataFrame) -> DataFrame:
    """One row: lowest and highest raw score of benign traffic."""
    return scored.agg(F.min("raw").alias("raw_min"), F.max("raw").alias("raw_max"))


def with_confidence(scored: DataFrame, benign: DataFrame) -> DataFrame:
    """Position of the raw score in the benign range, clamped to [0, 1]."""
    spread = F.col("raw_max") - F.col("raw_min")
    return (
        scored.crossJoin(F.broadcast(benign))  # one row
        .withColumn(
            "confidence",
            F.when(spread <= 0, 0.0).otherwise(
                F.least(F.greatest((F.col("raw") - F.col("raw_min")) / spread, F.lit(0.0)), F.lit(1.0))
            ),
        )
        .drop("raw_min", "raw_max")
    )


def detect_anomaly(scored: DataFrame, benign: DataFrame) -> DataFrame:
    """Flows above both limits."""
    return with_confidence(scored, benign).filter(
        (F.col("raw") > RAW_LIMIT) & (F.col("confidence") >= CONFIDENCE_LIMIT)
    )
