"""Resampling of documents towards the distribution of target texts.

Words and their offsets come from a pre-tokenizer's regular-expression split (nothing is
trained); windows over neighbouring offset pairs are the features. Hashed feature counts of all
documents and of all target texts give a gain per bucket, a document's weight is its mean gain,
and Gumbel noise by id turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import map_rows
from wiretally.session import materialise

#: A word is a run of digits, a-z and everything beyond ASCII (A-Z is lowered before).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHORTEST, LONGEST = 1, 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Texts are split piece by piece, cut between words about this many bytes apart.
PIECE_BYTES = 1 << 20
#: Buckets of features that a task remembers.
MEMO = 500_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
FEATURES = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"


@lru_cache(maxsize=1)
def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(WORD), behavior="removed", invert=True)


def words_with_offsets(text: str, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Pieces of the lowered text, each with the (start, end) code points of its words.

    Pieces end between words, so no word is cut; offsets count from the start of the piece.
    """
    data = text.encode().translate(_LOWER)
    split, at = splitter().pre_tokenize_str, 0
    while at < len(data):
        stop = _BREAK.search(data, at + piece_bytes)
        end = stop.end() if stop else len(data)
        piece = data[at:end].decode()
        yield piece, [pair for _, pair in split(piece)]
        at = end


def feature_counts(text: str, shortest: int, longest: int, buckets: int, memo: dict, piece_bytes: int = PIECE_BYTES) -> tuple[int, Counter]:
    """Number of words and counts of feature buckets of a text.

    A feature is a window of ``shortest`` to ``longest`` neighbouring offset pairs; its words
    are joined by one space and hashed by CRC-32. The last words of a piece start the
    windows of the next.
    """
    found: Counter = Counter()
    carried: list[str] = []
    n_words = 0
    for piece, offsets in words_with_offsets(text, piece_bytes):
        words = [piece[a:b] for a, b in offsets]
        n_words += len(words)
        for n in range(shortest, longest + 1):
            line = carried[max(0, len(carried) - n + 1) :] + words if n > 1 else words
            features = words if n == 1 else [" ".join(line[i : i + n]) for i in range(len(line) - n + 1)]
            for feature, count in Counter(features).items():
                bucket = memo.get(feature)
                if bucket is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    bucket = memo[feature] = zlib.crc32(feature.encode()) % buckets
                found[bucket] += count
        if longest > 1:
            carried = (carried + words)[-(longest - 1) :]
    return n_words, found


def features(texts: DataFrame, id_column: str, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and the bucket histogram of every text (null: no words).

    A histogram has at most ``buckets`` entries, however long the text.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        memo: dict = {}
        for batch in batches:
            found = [feature_counts(t or "", shortest, longest, buckets, memo) for t in batch["text"]]
            yield {
                "doc_id": batch["doc_id"],
                "n_words": [n for n, _ in found],
                "n_features": [c.total() for _, c in found],
                "buckets": [list(c) for _, c in found],
                "counts": [list(c.values()) for _, c in found],
            }

    return map_rows(texts.select(F.col(id_column).cast("long").alias("doc_id"), "text"), rows, FEATURES)


def histogram(found: DataFrame, name: str) -> DataFrame:
    """Feature count of each bucket over all texts."""
    entries = found.select(F.explode(F.arrays_zip("buckets", "counts")).alias("entry"))
    return entries.groupBy(F.col("entry.buckets").alias("bucket")).agg(F.sum("entry.counts").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, ``gains``: an array with the gain of each of the ``buckets`` buckets."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(histogram(corpus, "s"), "bucket", "left").join(histogram(target, "t"), "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    row = both.agg(
        F.sum("s").cast("double").alias("S"),
        F.sum("t").cast("double").alias("T"),
        F.sort_array(F.collect_list(F.struct("bucket", F.col("s").cast("double").alias("s"), F.col("t").cast("double").alias("t")))).alias("b"),
    )
    ratio = lambda x: (x["t"] + 1) * (F.col("S") + buckets) / ((x["s"] + 1) * (F.col("T") + buckets))
    return row.select(F.transform("b", lambda x: F.floor(1000 * F.log(ratio(x)))).alias("gains"))


def noise(ids: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by the id; a null id counts as an empty string."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def floored_mean(total: Column, n: Column) -> Column:
    """floor(total / n) in whole numbers; 0 where n is 0."""
    return F.when(n == 0, F.lit(0).cast("long")).otherwise((total - F.pmod(total, n)) / n).cast("long")


def weigh(corpus: DataFrame, gain: DataFrame, seed: int = SEED) -> DataFrame:
    """``weight`` and ``score`` of every document of ``features``."""
    table = gain.select("gains").scalar()
    total = F.aggregate(
        F.arrays_zip("buckets", "counts"), F.lit(0).cast("long"), lambda sum_, x: sum_ + x["counts"] * F.get(F.col("__gains"), x["buckets"])
    )
    weighed = corpus.withColumn("__gains", table).select("doc_id", "n_words", "n_features", floored_mean(total, F.col("n_features")).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def rank_best(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank``: 1, 2, 3, ... for the best ``percent`` of documents with ``least_words`` words, else null.

    Documents are sorted over all partitions by score (ties: smaller id, null ids last) and
    numbered there; a partition starts after the rows of those before it. No task sees more
    than its range, and rows that tie in all columns are split by a running number.
    """
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = F.col("n_words") >= least_words
    keyed = scored.withColumn("__fit", fit.cast("int")).withColumn("__tie", F.monotonically_increasing_id())
    order = [F.desc("__fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__tie")]
    lined = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = lined.withColumn("__at", F.monotonically_increasing_id()).drop("__tie")
    stored = materialise(placed.withColumn("__part", F.shiftright("__at", 33).cast("int")), "resample-order")
    sizes = sorted(stored.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum("__fit").alias("fit")).collect())
    wanted = percent * sum(s["fit"] for s in sizes) // 100
    before, start = 0, {}
    for s in sizes:
        start[s["__part"]] = before
        before += s["n"]
    starts = scored.sparkSession.createDataFrame(list(start.items()), "__part int, __start long")
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = stored.join(F.broadcast(starts), "__part", "left")
    return ranked.withColumn("rank", F.when((F.col("__fit") == 1) & (place <= wanted), place)).drop("__fit", "__at", "__part", "__start")


def resample(
    docs: DataFrame,
    target: DataFrame,
    shortest: int = SHORTEST,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Every document with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn).

    ``docs`` (doc_id, text) and ``target`` (item_id, text) are counted whole. Null and empty
    texts have no features and weight 0; repeated rows are documents of their own, each drawn for
    itself; null ids share one noise and come last among ties. Without documents the result
    is empty; without target texts every bucket counts as seen once. Other columns are not read.
    What goes through the driver is one count per partition; the gain table has ``buckets`` entries.
    """
    found = materialise(features(docs, "doc_id", shortest, longest, buckets), "resample-features")
    aimed = features(target, "item_id", shortest, longest, buckets)
    return rank_best(weigh(found, gains(found, aimed, buckets), seed), least_words, percent)


def oracle() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH step AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), d AS (
  SELECT doc_id, {words} AS words FROM documents
), dw AS (
  SELECT doc_id, unnest(words) AS word FROM d
), bw AS (
  SELECT unnest({words}) AS word FROM benchmark
), vocabulary AS (
  SELECT word, [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(word)), '..')] AS bytes
  FROM (SELECT word FROM dw UNION SELECT word FROM bw)
), hashed AS (
  SELECT word, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
  FROM vocabulary, step
), corpus AS (
  SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT coalesce((SELECT sum(s) FROM corpus), 0)::DOUBLE AS cs, coalesce((SELECT sum(t) FROM target), 0)::DOUBLE AS ct
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (cs + {BUCKETS}) / ((coalesce(s, 0)::DOUBLE + 1) * (ct + {BUCKETS}))))::BIGINT AS gain
  FROM corpus FULL JOIN target USING (bucket), totals
), summed AS (
  SELECT doc_id, sum(gain)::BIGINT AS total FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), weighed AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_features,
         CASE WHEN len(words) = 0 THEN 0 ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END::BIGINT AS weight,
         list_reduce([instr('0123456789abcdef', c) - 1 FOR c IN string_split(sha256('{SEED}:' || d.doc_id)[1:8], '')], lambda a, b: a * 16 + b, 0::BIGINT)::DOUBLE AS h
  FROM d LEFT JOIN summed ON d.doc_id = summed.doc_id
), scored AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM weighed
), placed AS (
  SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place
  FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT {PERCENT} * count(*) // 100 FROM scored WHERE n_features >= {LEAST_WORDS}) THEN place END::BIGINT AS rank
FROM placed
"""
