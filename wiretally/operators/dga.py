"""Generated-domain features, reference models and classifier."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.functions.domains import candidate_label
from wiretally.functions.stats import char_entropy
from wiretally.operators.evaluate import confusion, f_scores
from wiretally.session import materialise

# Character classes, shortest word, likelihood of an unseen bigram.
VOWELS = "aeiou"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
MIN_WORD = 3
MAX_LABEL = 63
UNSEEN_LOG10 = -4.5
#: Bytes of words up to which an automaton is broadcast; it takes some fifty times as much in a worker.
AUTOMATON_BYTES = 4 << 20
FEATURES = (
    "label_length",
    "label_entropy",
    "digit_ratio",
    "vowel_consonant_ratio",
    "longest_word_ratio",
    "bigram_distance",
)


def labels_of(domains: DataFrame, column: str = "domain") -> DataFrame:
    """Distinct candidate labels of the names."""
    return domains.select(candidate_label(column).alias("label")).filter(F.col("label") != "").distinct()


def lexical_features(labels: DataFrame) -> DataFrame:
    """Length, character entropy, digit ratio and vowel-to-consonant ratio."""
    label = F.col("label")
    n = F.length(label)
    count_of = lambda pattern: F.regexp_count(label, F.lit(pattern))
    vowels, consonants = count_of(f"[{VOWELS}]"), count_of(f"[{CONSONANTS}]")
    return labels.select(
        "label",
        n.cast("double").alias("label_length"),
        char_entropy(label).alias("label_entropy"),
        F.round(count_of("[0-9]") / n, 6).alias("digit_ratio"),
        F.when(consonants > 0, F.round(vowels / consonants, 6))
        .otherwise(vowels.cast("double"))
        .alias("vowel_consonant_ratio"),
    )


def _longest_by_automaton(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, _longest): labels walked once each through an Aho-Corasick automaton of a bounded word list."""
    from ahocorasick import Automaton

    automaton = Automaton()
    for row in words.toLocalIterator():
        automaton.add_word(row.word, len(row.word))
    if not len(automaton):
        return labels.select("label", F.lit(0).alias("_longest"))
    automaton.make_automaton()
    shared = labels.sparkSession.sparkContext.broadcast(automaton)

    def longest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = [max((n for _, n in shared.value.iter(label)), default=0) for label in frame.label]
            yield pd.DataFrame({"label": frame.label, "_longest": best})

    return labels.where(F.col("label").isNotNull()).select("label").mapInPandas(longest, "label string, _longest int")


def _longest_by_join(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, _longest): substrings, a bounded number per label, joined to a word list of any size."""
    n = F.length("label")
    starts = labels.filter(n >= MIN_WORD).select(
        "label", n.alias("_n"), F.explode(F.sequence(F.lit(1), n - MIN_WORD + 1)).alias("_at")
    )
    longest = F.least(F.col("_n") - F.col("_at") + 1, F.lit(MAX_LABEL))
    pieces = starts.select(
        "label",
        F.explode(
            F.transform(F.sequence(F.lit(MIN_WORD), longest), lambda k: F.substring(F.col("label"), F.col("_at"), k))
        ).alias("word"),
    )
    return pieces.distinct().join(words, "word", "left_semi").groupBy("label").agg(F.max(F.length("word")).alias("_longest"))


def longest_word_ratio(labels: DataFrame, words: DataFrame, bound: int = AUTOMATON_BYTES) -> DataFrame:
    """Length of the longest listed word inside each distinct label, relative to the label.

    A word list of at most ``bound`` bytes becomes an automaton, which each worker holds once; a
    longer one is joined with the substrings of the labels. Words have 3 to 63 characters.
    """
    size = F.length("word")
    listed = words.select("word").where((size >= MIN_WORD) & (size <= MAX_LABEL)).distinct()
    listed = materialise(listed, "word-list")
    held = listed.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    best = _longest_by_automaton(labels, listed) if held <= bound else _longest_by_join(labels, listed)
    return labels.join(best, "label", "left").select(
        "label", F.round(F.coalesce("_longest", F.lit(0)) / F.length("label"), 6).alias("longest_word_ratio")
    )


def _bigrams(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    clean = F.regexp_replace(text, "[^a-z0-9_-]", "")
    return (
        df.withColumn("_clean", clean)
        .filter(F.length("_clean") > 1)
        .select(
            *key,
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.length("_clean") - 1),
                    lambda i: F.substring(F.col("_clean"), i, F.lit(2)),
                )
            ).alias("bigram"),
        )
    )


def fit_bigrams(words: DataFrame) -> DataFrame:
    """log10 likelihood of each bigram of the word list, with add-one smoothing."""
    counts = _bigrams(words, "word", []).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg((F.sum("n") + F.count(F.lit(1))).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(  # one row
        "bigram", F.log10((F.col("n") + 1) / F.col("_total")).alias("log10_p")
    )


def bigram_distance(labels: DataFrame, model: DataFrame) -> DataFrame:
    """Mean negative log10 likelihood over the bigrams of each label."""
    scored = (
        _bigrams(labels, "label", ["label"])
        .join(model, "bigram", "left")
        .groupBy("label")
        .agg(F.round(-F.avg(F.coalesce("log10_p", F.lit(UNSEEN_LOG10))), 6).alias("_d"))
    )
    return labels.join(scored, "label", "left").select(
        "label", F.coalesce("_d", F.lit(0.0)).alias("bigram_distance")
    )


def dga_features(labels: DataFrame, words: DataFrame, model: DataFrame) -> DataFrame:
    """All six features per distinct label."""
    return (
        lexical_features(labels)
        .join(longest_word_ratio(labels, words), "label")
        .join(bigram_distance(labels, model), "label")
    )


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")


def train_dga(training: DataFrame, seed: int = 42) -> PipelineModel:
    """Random forest on balanced weights; ``training`` has the features and ``label01``."""
    counts = training.groupBy("label01").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    weights = counts.crossJoin(F.broadcast(total)).select(  # one row against two
        "label01", (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight")
    )
    forest = RandomForestClassifier(
        labelCol="label01",
        weightCol="weight",
        numTrees=100,
        maxDepth=12,
        minInstancesPerNode=2,
        seed=seed,
    )
    return Pipeline(stages=[_assembler(), forest]).fit(training.join(weights, "label01"))


def predict(features: DataFrame, model: PipelineModel) -> DataFrame:
    scored = model.transform(features)
    return scored.withColumn("probability_dga", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def threshold_sweep(scored: DataFrame, low: int = 30, high: int = 85, step: int = 5) -> DataFrame:
    """Precision, recall and F1 per threshold (in percent), from one pass of counts."""
    grid = F.array(*[F.lit(t / 100) for t in range(low, high + 1, step)])
    tried = scored.select("label01", "probability_dga", F.explode(grid).alias("threshold")).withColumn(
        "predicted", (F.col("probability_dga") >= F.col("threshold")).cast("int")
    )
    return f_scores(confusion(tried, "label01", "predicted", ["threshold"]))


def best_threshold(sweep: DataFrame) -> float:
    """Threshold with the best F1; the lowest wins a tie. The sweep has twelve rows."""
    return float(sweep.orderBy(F.desc("f1"), "threshold").first()["threshold"])


def detect_dga(
    dns: DataFrame, words: DataFrame, bigrams: DataFrame, model: PipelineModel, threshold: float
) -> DataFrame:
    """DNS queries whose label looks generated. Labels are scored once each."""
    queries = dns.withColumn("label", candidate_label("query"))
    labels = queries.select("label").filter(F.col("label") != "").distinct()
    scores = predict(dga_features(labels, words, bigrams), model).filter(F.col("probability_dga") >= threshold)
    return (
        queries.join(scores.select("label", "probability_dga"), "label")
        .withColumn("source", F.col("src"))
        .withColumn("destination", F.col("dst"))
        .withColumn("severity", F.lit("high"))
        .withColumn("confidence", F.col("probability_dga"))
        .withColumn("flow_id", F.concat_ws("_", F.lit("dga_dns"), "src", "dst", "label"))
    )


def detection_rate(scored: DataFrame, threshold: float, dataset: str = "dataset") -> DataFrame:
    """Share of queries detected per dataset."""
    hit = F.col("probability_dga") >= threshold
    return scored.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(hit).alias("detected"),
        F.round(F.avg(hit.cast("double")), 6).alias("detection_rate"),
    )
