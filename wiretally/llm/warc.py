"""Derivatives of web captures: metadata and plain-text conversion records, linked to their responses.

Every response record gives a ``metadata`` record (title, language, links, and the headers of
the source) and a ``conversion`` record (its text). Both name the response in WARC-Refers-To and
carry digests of their own block and of the payload they stem from. All of it is column
expressions; ``write`` stores the records as gzip files of concatenated WARC records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
RESPONSE_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
#: In order: what is cut with its content, what ends a line, any other tag.
CUT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
LINE_ENDS = r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/article|/section|/ul|/ol|/table|/title|/nav)\b[^>]*>"
TAG = r"(?s)</?[A-Za-z!][^>]*>"
#: Character references and what they stand for; the ampersand comes last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def uuid_urn(*parts: Column) -> Column:
    """An identifier that depends on the parts alone, so that a rerun writes the same records."""
    mark = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    groups = [F.substring(mark, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *groups))


def responses(pages: DataFrame, date: str = DATE, headers: str = RESPONSE_HEADERS) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html): record_id, page_id, target_uri, date, http_headers, payload."""
    return pages.select(
        uuid_urn(F.lit("response"), F.col("page_id"), F.col("url"), F.col("html")).alias("record_id"),
        "page_id",
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit(headers).alias("http_headers"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )


def unreferenced(text: Column) -> Column:
    for name, sign in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def plain_text(html: Column) -> Column:
    """Text of a page: one line per block, white space collapsed, no empty lines."""
    text = F.regexp_replace(html, CUT, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\n\f]+", " "), LINE_ENDS, "\n")
    text = F.regexp_replace(unreferenced(F.regexp_replace(text, TAG, " ")), r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)
    return F.trim(F.regexp_replace(unreferenced(found), r"[ \t\r\n\f]+", " "))


def links(html: Column) -> Column:
    """Targets of all links, in order, repeats included."""
    return F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def derive(records: DataFrame) -> DataFrame:
    """Two records per response: columns of the record, its WARC headers, and its block.

    ``records``: record_id, target_uri, date, http_headers, payload, and any others, of which
    ``page_id`` is kept if present. Null and empty payloads give an empty text and no title or
    links; repeated responses give repeated records; an empty table gives none.
    """
    payload = F.coalesce("payload", F.lit(""))
    held = [F.col("page_id")] if "page_id" in records.columns else []
    source = records.select(
        *held,
        "record_id",
        "target_uri",
        "date",
        "http_headers",
        digest(payload).alias("source_digest"),
        title(payload).alias("title"),
        F.regexp_extract(payload, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1).alias("language"),
        links(payload).alias("links"),
        plain_text(payload).alias("text"),
    )
    lines = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    fields = lines(
        "title: ", F.col("title"), CRLF, "language: ", F.col("language"), CRLF, "source-digest: ", F.col("source_digest"), CRLF,
        F.concat_ws("", F.transform(F.split("http_headers", CRLF), lambda h: F.concat(F.lit("source-header: "), h, F.lit(CRLF)))),
        F.concat_ws("", F.transform("links", lambda u: F.concat(F.lit("outlink: "), u, F.lit(CRLF)))),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    both = source.withColumn("kind", F.explode(kinds)).select(*source.columns, "kind.*")
    both = both.select(
        *held,
        "record_type",
        uuid_urn(F.col("record_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "content_type",
        F.size("links").cast("long").alias("n_links"),
        "title",
        "language",
        "source_digest",
        digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"),
        "block",
    )
    headers = lines(
        "WARC/1.1", CRLF, "WARC-Type: ", F.col("record_type"), CRLF, "WARC-Record-ID: <", F.col("record_id"), ">", CRLF,
        "WARC-Refers-To: <", F.col("refers_to"), ">", CRLF, "WARC-Target-URI: ", F.col("target_uri"), CRLF,
        "WARC-Date: ", F.col("date"), CRLF, "WARC-Payload-Digest: ", F.col("source_digest"), CRLF,
        "WARC-Block-Digest: ", F.col("block_digest"), CRLF, "Content-Type: ", F.col("content_type"), CRLF,
        "Content-Length: ", F.col("content_length").cast("string"), CRLF,
    )
    return both.withColumn("headers", headers)


def write(records: DataFrame, path: str) -> None:
    """Store derived records as gzip files of WARC records; each record ends with two line breaks, as the format says."""
    body = records.select(F.concat("headers", F.lit(CRLF), "block").alias("value"))
    body.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


#: The same for DuckDB, over the table ``pages``.
ORACLE = r"""
WITH source AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
    md5(concat_ws('|', 'response', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''), coalesce(html, ''))) AS mark
  FROM pages),
named AS (
  SELECT page_id, target_uri, payload, 'sha256:' || sha256(payload) AS source_digest,
    'urn:uuid:' || concat_ws('-', substr(mark,1,8), substr(mark,9,4), substr(mark,13,4), substr(mark,17,4), substr(mark,21,12)) AS refers_to,
    regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1) AS raw_title,
    regexp_extract(payload, '(?i)<html[^>]*\blang=["'']?([A-Za-z-]+)', 1) AS language,
    regexp_extract_all(payload, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1) AS links,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(payload,
      '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', ' ', 'g'),
      '[ \t\r\n\f]+', ' ', 'g'),
      '(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/article|/section|/ul|/ol|/table|/title|/nav)\b[^>]*>', chr(10), 'g'),
      '(?s)</?[A-Za-z!][^>]*>', ' ', 'g') AS raw_text
  FROM source),
texts AS (
  SELECT page_id, target_uri, source_digest, refers_to, language, links,
    trim(regexp_replace({title}, '[ \t\r\n\f]+', ' ', 'g'), ' ') AS title,
    regexp_replace(regexp_replace(regexp_replace({text}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text
  FROM named),
both_kinds AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || title || chr(13) || chr(10) || 'language: ' || language || chr(13) || chr(10) || 'source-digest: ' || source_digest || chr(13) || chr(10)
    || 'source-header: HTTP/1.1 200 OK' || chr(13) || chr(10) || 'source-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || array_to_string(list_transform(links, lambda u: 'outlink: ' || u || chr(13) || chr(10)), '') AS block
  FROM texts
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM texts),
marked AS (
  SELECT *, md5(concat_ws('|', record_type, refers_to)) AS own FROM both_kinds),
done AS (
  SELECT page_id, record_type,
    'urn:uuid:' || concat_ws('-', substr(own,1,8), substr(own,9,4), substr(own,13,4), substr(own,17,4), substr(own,21,12)) AS record_id,
    refers_to, target_uri, '1970-01-01T00:00:00Z' AS "date", content_type, CAST(len(links) AS BIGINT) AS n_links, title, language,
    source_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block
  FROM marked)
SELECT *, array_to_string(['WARC/1.1', 'WARC-Type: ' || record_type, 'WARC-Record-ID: <' || record_id || '>',
  'WARC-Refers-To: <' || refers_to || '>', 'WARC-Target-URI: ' || target_uri, 'WARC-Date: ' || "date",
  'WARC-Payload-Digest: ' || source_digest, 'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || content_type,
  'Content-Length: ' || content_length, ''], chr(13) || chr(10)) AS headers
FROM done
"""


def oracle() -> str:
    def decoded(column: str) -> str:
        for name, sign in REFERENCES:
            column = f"replace({column}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
        return column

    return ORACLE.format(title=decoded("raw_title"), text=decoded("raw_text"))
