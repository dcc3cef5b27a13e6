"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of the letter triples of its words. The training texts of
each language are clustered; the most similar of all centroids by cosine names the language, and
a text that is far from every centroid is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import fold, map_rows
from wiretally.session import materialise

#: Classes of :func:`letter_table`: 0 (between words), 26 Latin letters, 31 accented ones and hashed rest.
LETTERS = 64
#: Triples of lower-case code points are hashed to so many dimensions.
DIMENSIONS = 1 << 20
CENTROIDS = 4
ROUNDS = 8
#: Training texts of a language that are clustered: at most this many, those with the least hashes of their ids.
#: Document frequencies count all training texts.
SAMPLE = 800
#: Cosine with the nearest centroid below which a text is flagged as of no learned language.
REJECT_BELOW = 0.15
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Class of each code point below 65,536; 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        letter = chr(code)
        if not letter.isalpha():
            continue
        low = letter.lower()
        base = ord(low) if len(low) == 1 else code
        if 97 <= base <= 122:
            table[code] = base - 96
        elif 0xDF <= base <= 0xFF:
            table[code] = 27 + base - 0xDF
        else:
            table[code] = 60 + (base >> 7) % 4
    return table


def point_table() -> np.ndarray:
    """Lower-case code point of each letter below 65,536; 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint64)
    for code in range(1 << 16):
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_TABLE: list[np.ndarray] = []


def triples(text: str) -> np.ndarray:
    """Hashed codes of all letter triples that hold a letter in the middle."""
    if not _TABLE:
        _TABLE.append(point_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.zeros(len(points) + 2, np.uint64)
    far = points >= 1 << 16
    letters[1:-1] = _TABLE[0][np.where(far, 0, points)]
    if far.any():
        letters[1:-1][far] = [ord(chr(p).lower()) if chr(p).isalpha() else 0 for p in points[far]]
    codes = (letters[:-2] << np.uint64(42)) | (letters[1:-1] << np.uint64(21)) | letters[2:]
    codes = (codes ^ codes >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    codes = (codes ^ codes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (codes >> np.uint64(44)).astype(np.int64)[letters[1:-1] > 0]


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions in use and their dampened counts."""
    codes, counts = np.unique(triples(text), return_counts=True)
    return codes, 1 + np.log(counts)


def _frequency_rows(batches: Iterator[dict]) -> Iterator[dict]:
    seen, texts = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            seen[np.unique(triples(text))] += 1
            texts += 1
    used = np.nonzero(seen)[0]
    yield {"code": [*used.tolist(), -1], "n": [*seen[used].tolist(), texts]}


def _vector_rows(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        found = [vector(t) for t in batch["text"]]
        yield {
            "lang": batch["lang"],
            "mark": batch["mark"],
            "codes": [codes.astype(np.int32).tobytes() for codes, _ in found],
            "weights": [weights.astype(np.float32).tobytes() for _, weights in found],
        }


def _cluster(rows: pd.DataFrame, idf: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Spherical k-means over the vectors of one language; the first centres are far from each other.

    Returns the dimensions that occur and the centres over them.
    """
    pairs = [(np.frombuffer(c, np.int32), np.frombuffer(w, np.float32)) for c, w in zip(rows["codes"], rows["weights"])]
    used = np.unique(np.concatenate([codes for codes, _ in pairs]))
    vectors = np.zeros((len(pairs), len(used)), np.float32)
    for n, (codes, weights) in enumerate(pairs):
        vectors[n, np.searchsorted(used, codes)] = weights * idf[codes]
    length = np.linalg.norm(vectors, axis=1)
    vectors = vectors[length > 0] / length[length > 0, None]
    if not len(vectors):
        return used, []
    mean = vectors.mean(axis=0)
    centres = [mean / np.linalg.norm(mean)]
    nearest = vectors @ centres[0]
    while len(centres) < min(CENTROIDS, len(vectors)):
        centres.append(vectors[int(nearest.argmin())])
        nearest = np.maximum(nearest, vectors @ centres[-1])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (own == k).any():
                mean = vectors[own == k].mean(axis=0)
                centres[k] = mean / np.linalg.norm(mean)
    return used, list(centres)


class Model:
    """``centroids`` has a row for each dimension of ``used`` (sorted), the others are zero."""

    def __init__(self, idf: np.ndarray, languages: list[str], used: np.ndarray, centroids: np.ndarray):
        self.idf, self.languages, self.used, self.centroids = idf, languages, used, centroids

    def nearest(self, text: str) -> tuple[str, float]:
        """The language of the nearest centroid and its cosine, or ``und`` and 0 where the text has no letter."""
        codes, weights = vector(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        weights = weights * self.idf[codes]
        length = np.linalg.norm(weights)
        at = np.minimum(np.searchsorted(self.used, codes), len(self.used) - 1)
        hit = self.used[at] == codes
        likeness = self.centroids[at[hit]].T @ weights[hit] / length
        best = int(likeness.argmax())
        return self.languages[best], float(min(max(likeness[best], 0.0), 1.0))


def train(docs: DataFrame, sample: int = SAMPLE):
    """Broadcast model from the text and ``lang`` of ``docs``; rows without either are left out.

    Its size is bounded by the number of languages: a language has at most ``CENTROIDS``
    vectors of ``DIMENSIONS`` numbers.
    """
    spark = docs.sparkSession
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counted = map_rows(known.select("text"), _frequency_rows, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = counted.toPandas()
    codes, n = counts["code"].to_numpy(), counts["n"].to_numpy()
    texts = int(n[codes < 0].sum())
    idf = np.full(DIMENSIONS, np.log(1 + texts), np.float32)
    idf[codes[codes >= 0]] = np.log((1 + texts) / (1 + n[codes >= 0])) + 0.05
    idf_held = spark.sparkContext.broadcast(idf)
    limits = materialise(_limits(known, sample), "language-samples")
    near = known.select("lang", "text", F.xxhash64("doc_id").alias("mark")).join(limits, "lang").where("mark <= most")
    vectors = map_rows(near.select("lang", "text", "mark"), _vector_rows, "lang string, mark long, codes binary, weights binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "codes"))
    chosen = vectors.withColumn("rank", rank).where(F.col("rank") <= sample)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        used, centres = _cluster(rows.sort_values("rank"), idf_held.value)
        lang = rows["lang"].iloc[0]
        found = [(lang, k, used.astype(np.int32).tobytes(), c.astype(np.float32).tobytes()) for k, c in enumerate(centres)]
        return pd.DataFrame(found, columns=["lang", "k", "codes", "weights"])

    parts = chosen.groupBy("lang").applyInPandas(fit, "lang string, k int, codes binary, weights binary").collect()
    parts.sort(key=lambda r: (r["lang"], r["k"]))
    own = [np.frombuffer(p["codes"], np.int32) for p in parts]
    used = np.unique(np.concatenate([np.zeros(0, np.int32), *own]))
    centroids = np.zeros((len(used), len(parts)), np.float32)
    for n, part in enumerate(parts):
        centroids[np.searchsorted(used, own[n]), n] = np.frombuffer(part["weights"], np.float32)
    return spark.sparkContext.broadcast(Model(idf, [p["lang"] for p in parts], used, centroids))


def _limits(known: DataFrame, sample: int) -> DataFrame:
    """(lang, most): hashes up to ``most`` hold the sample of a language, with some to spare, for hashes are uniform."""
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n"))
    most = (share * F.lit(2.0**64) - F.lit(2.0**63)).cast("decimal(20,0)")
    return sizes.select("lang", F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise(most.cast("long")).alias("most"))


def identify(docs: DataFrame, model, reject_below: float = REJECT_BELOW) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (cosine, 0 to 1), and ``rejected`` where the nearest centroid is too far.

    A text that is null or has no letter gets ``und``, score 0 and is rejected. Repeated rows
    are judged each, other columns are ignored, an empty table gives no row.
    """

    def rows(batches):
        for batch in batches:
            found = [model.value.nearest(t or "") for t in batch["text"]]
            yield {
                "doc_id": batch["doc_id"],
                "lang_pred": [f[0] for f in found],
                "score": [f[1] for f in found],
                "rejected": [f[0] == UNKNOWN or f[1] < reject_below for f in found],
            }

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(texts, rows, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    return F.coalesce(fold(3) == 1, F.lit(False))


def predict(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the rows outside the fold that is held out, and identify all rows."""
    model = train(docs.where(fold(3) != 1), sample)
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
