"""Lines that many documents share are kept in one of them only; DataFrame functions throughout.

Lines are exploded with their positions, normalised and hashed; distinct documents are counted
per hash; lines of hashes over the threshold are dropped by position and the rest reassembled.
Only hashes, ids and positions are shuffled for the search; texts move once, at the end.
Hashes and shared keys are written once: lines are hashed a single time, and the join reads two
plain tables, so a key of very many lines can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.session import materialise

#: Keys shorter than this (in code points) never count as shared lines.
LEAST_CHARS = 40
#: Documents that must hold a key before it is dropped.
LEAST_DOCS = 5
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text, at least one; a null text is an empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def digest(value: Column) -> Column:
    """128 bits of a string."""
    return F.unhex(F.md5(value.cast("binary")))


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``row``: 128 bits of both, which only equal rows share."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("row", digest(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))))


def keyed_lines(rows: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id``, ``row``, position and key hash of every line that is long enough."""
    lines = rows.select("doc_id", "row", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.where(F.char_length("line") >= least_chars).select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= least_chars).select("doc_id", "row", "pos", digest(F.col("key")).alias("hash"))


def shared_keys(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``hash``, ``docs`` and ``last`` (the largest id) of keys held by at least ``least_docs`` documents.

    A document is an id; all rows without an id are one document. Pairs of key and document
    are made distinct first, dealt by both, so a key of all documents is summed map-side.
    """
    pairs = lines.select("hash", "doc_id").distinct()
    counted = pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
    return counted.where(F.col("docs") >= least_docs)


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Every document with its shared lines dropped: ``doc_id``, ``text``, ``n_lines``, ``n_dropped``.

    A line is dropped where its key has ``least_chars`` code points, ``least_docs`` documents
    hold it and another document that holds it has a larger id: the document with the largest
    id keeps all its copies. Null or empty texts are one empty line. Rows without an id
    count as one document, smaller than all others; rows that share an id count once but are
    returned each; equal rows come back as often as they came. A text that loses all its lines
    is empty. An empty table gives no row; columns other than ``doc_id`` and ``text`` are not read.
    """
    rows = _rows(docs)
    lines = materialise(keyed_lines(rows, least_chars), "line-keys")
    shared = materialise(shared_keys(lines, least_docs), "shared-lines")
    hits = lines.join(shared.select("hash", "last"), "hash").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    dropped = hits.groupBy("row").agg(F.collect_set("pos").alias("dropped"))
    found = rows.join(dropped, "row", "left").withColumn("lines", lines_of(F.col("text")))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(every, F.col("dropped")), lambda n: F.get(F.col("lines"), n))
    none = F.col("dropped").isNull()
    return found.select(
        "doc_id",
        F.when(none, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
    )


def with_digest(dropped: DataFrame) -> DataFrame:
    """``drop_lines`` with the SHA-256 of the kept text in its place."""
    return dropped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {white}), '{UPPER}', '{LOWER}') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed
  WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
