"""SimHash fingerprints by DataFrame functions, with search through permuted block tables.

Terms are pairs of neighbouring words (a lone word is a term), weighted by how often they occur.
Two 64-bit hashes of a term vote on 128 bits; a bit is set where the set votes outweigh the
others. Votes are summed two bits to a long, so a document needs 64 sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 128
PAIR = (1 << 32) | 1
#: Ranges of ids per shuffle partition; each range also reads the first document of the next.
RANGES_PER_PARTITION = 8


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def term_hashes(hashed: Column) -> Column:
    """One hash per occurrence of a term: neighbouring words, or the only word."""
    after = F.slice(hashed, 2, F.greatest(F.size(hashed) - 1, F.lit(1)))
    return F.zip_with(F.slice(hashed, 1, F.greatest(F.size(hashed) - 1, F.lit(1))), after, lambda a, b: F.xxhash64(a, b))


def _votes(term: Column) -> list[Column]:
    """Sums of the set bits, bits n and n + 32 of each hash in one long."""
    halves = (term, F.xxhash64(term, F.lit(1)))
    return [
        F.sum(F.shiftrightunsigned(F.coalesce(half, F.lit(0)), n).bitwiseAND(F.lit(PAIR))).alias(f"__votes_{h}_{n}")
        for h, half in enumerate(halves)
        for n in range(32)
    ]


def _half_print(half: int, total: Column) -> Column:
    """64 bits of the fingerprint from the sums of one hash."""
    bits = F.lit(0).cast("long")
    for n in range(32):
        votes = F.col(f"__votes_{half}_{n}")
        low = (votes.bitwiseAND(F.lit((1 << 32) - 1)) * 2 > total).cast("long")
        high = (F.shiftrightunsigned(votes, 32) * 2 > total).cast("long")
        bits = bits.bitwiseOR(F.shiftleft(low, n)).bitwiseOR(F.shiftleft(high, n + 32))
    return bits


def prints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``hi`` and ``lo``: the fingerprint of each row; ``keys`` tell rows apart.

    Needs no shuffle where ``texts`` is dealt out by one of the keys. A null or empty text has
    the fingerprint zero.
    """
    hashed = texts.select(*keys, word_hashes(F.coalesce(text, F.lit(""))).alias("__words"))
    terms = hashed.select(*keys, F.explode_outer(term_hashes(F.col("__words"))).alias("__term"))
    votes = terms.groupBy(*keys).agg(F.count("__term").alias("__total"), *_votes(F.col("__term")))
    empty = F.col("__total") == 0
    zero = F.lit(0).cast("long")
    return votes.select(
        *keys,
        F.when(empty, zero).otherwise(_half_print(1, F.col("__total"))).alias("hi"),
        F.when(empty, zero).otherwise(_half_print(0, F.col("__total"))).alias("lo"),
    )


def distance(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def hexed(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def near_pairs(found: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a_hi, a_lo, b_hi, b_lo, distance) of distinct fingerprints within ``radius`` bits.

    A table per block: the bits fall into at least ``radius`` + 1 blocks, so two fingerprints within the
    radius agree on some block, and the table keyed by it brings them together. Copies meet as
    one fingerprint first.
    """
    per_half = (radius + 2) // 2
    width = 64 // per_half
    distinct = found.select("hi", "lo").distinct()
    blocks = []
    for half in ("hi", "lo"):
        for n in range(per_half):
            bits = 64 - width * n if n == per_half - 1 else width
            mask = (1 << bits) - 1
            block = F.shiftrightunsigned(half, width * n).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long"))
            blocks.append(F.struct(F.lit(len(blocks)).alias("table"), block.alias("block")))
    tables = distinct.select("hi", "lo", F.explode(F.array(*blocks)).alias("key"))
    left = tables.select("key", F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"))
    right = tables.select("key", F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"))
    gap = distance(F.col("a_hi"), F.col("a_lo"), F.col("b_hi"), F.col("b_lo"))
    met = left.join(right, "key").where("a_hi < b_hi OR (a_hi = b_hi AND a_lo < b_lo)")
    return met.select("a_hi", "a_lo", "b_hi", "b_lo", gap.alias("distance")).where(F.col("distance") <= radius).distinct()


def _ranges(docs: DataFrame) -> list[int]:
    """Rising ids that cut the table into ranges of about equal size."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    found = docs.select("doc_id").na.drop().approxQuantile("doc_id", [n / parts for n in range(1, parts)], 1 / (2 * parts))
    return sorted({max(-(1 << 63), min(int(x), (1 << 63) - 1)) for x in found})


def _range_of(ids: Column, bounds: list[int]) -> Column:
    """How many bounds an id reaches, found in two steps; -1 for a null id."""
    if not bounds:
        return F.when(ids.isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(F.lit(bounds[::step]), lambda b: b <= ids))
    start = F.greatest((coarse - 1) * step, F.lit(0))
    fine = F.size(F.filter(F.slice(F.lit(bounds), start + 1, F.lit(step)), lambda b: b <= ids))
    return F.when(ids.isNull(), -1).otherwise(start + fine)


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like the next document's it is.

    The next document is the one with the next smaller id (the largest after the last); the
    edited text has its last half replaced by the start of the next text. Null ids come last;
    rows that share an id follow each other by the hash of their texts. A null text counts as
    empty, an empty table gives no row, a single row is its own next, other columns are ignored.
    Texts are shuffled once, by ranges of ids; each range also holds the first row of the next.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _ranges(docs)
    ranged = docs.withColumn("range", _range_of(F.col("doc_id"), bounds))
    heads = {r["range"]: r["doc_id"] for r in ranged.groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()}
    order = sorted(heads, reverse=True)
    before = {here: there for there, here in zip(order, order[1:] + order[:1])}
    head_ids = [i for i in heads.values() if i is not None]
    near = F.col("doc_id").isin(head_ids) if head_ids else F.lit(False)
    if -1 in heads:
        near = near | F.col("doc_id").isNull()
    by_id = [F.desc_nulls_last("doc_id"), F.xxhash64("text"), F.col("text")]
    firsts = ranged.where(near).withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy(*by_id))).where("n = 1")
    moved = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("range")) if before else F.lit(0)
    firsts = firsts.select("doc_id", "text", moved.alias("range"), F.lit(True).alias("guest"))
    both = ranged.select("doc_id", "text", "range", F.lit(False).alias("guest")).unionByName(firsts)
    rows = Window.partitionBy("range").orderBy("guest", *by_id)
    lined = both.select("*", F.row_number().over(rows).alias("n"), F.lead("text").over(rows).alias("next"))
    half = F.expr("char_length(text) div 2")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)"), F.substring("next", F.lit(1), half))
    lined = lined.withColumn("edited", F.when(F.col("guest"), F.lit("")).otherwise(edited))
    keys = ["range", "n", "doc_id", "guest", "n_chars", "digest"]
    lined = lined.select(
        "range",
        "n",
        "doc_id",
        "guest",
        F.char_length("text").cast("long").alias("n_chars"),
        F.unhex(F.sha2("edited", 256)).alias("digest"),
        F.explode(F.array(F.struct(F.lit(0).alias("version"), "text"), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text")))).alias("__v"),
    )
    found = prints(lined.select(*keys, "__v.version", "__v.text"), [*keys, "version"])
    pick = lambda half, version: F.max(F.when(F.col("version") == version, F.col(half)))
    found = found.groupBy(*keys).agg(
        *(pick(half, version).alias(f"{half}_{version}") for half in ("hi", "lo") for version in (0, 1))
    )
    line = Window.partitionBy("range").orderBy("n")
    found = found.select("*", F.lead("hi_0").over(line).alias("next_hi"), F.lead("lo_0").over(line).alias("next_lo"))
    like = lambda hi, lo: 1 - distance(F.col("hi_0"), F.col("lo_0"), F.col(hi), F.col(lo)) / BITS
    return found.where("NOT guest").select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("digest")).alias("edited_sha256"),
        hexed(F.col("hi_0"), F.col("lo_0")).alias("fingerprint"),
        hexed(F.col("hi_1"), F.col("lo_1")).alias("edited_fingerprint"),
        like("hi_1", "lo_1").alias("near_edited"),
        like("next_hi", "next_lo").alias("near_next"),
    )
