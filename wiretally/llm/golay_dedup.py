"""Near-duplicate groups by SimHash and Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect binary Golay code
assigns every 23-bit word to the one codeword within three bits; the codewords of a segment and
of its one-bit neighbours are its keys (at most seven, mostly six). Two segments that differ in
at most two bits have a word half way between them, hence share a key. Of two fingerprints that
differ in at most two bits, some segment is equal (pigeonhole), and the next segment differs in at most two; so each
fingerprint is filed under (equal segment, key of the next segment) and no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import map_rows, texts_of
from wiretally.llm.components import components
from wiretally.session import materialise, release

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
RADIUS = 2
SHINGLE = 3
SEED = 42
#: Members of a key that are compared pair by pair; larger keys are linked through half-way words.
PAIRED = 64


@lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each bit of a 23-bit word, and the error pattern (up to three bits) of each syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << bit - 11
        return word

    unit = np.array([remainder(1 << bit) for bit in range(23)], np.uint32)
    errors = np.zeros(2048, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            errors[np.bitwise_xor.reduce(unit[list(bits)])] = sum(1 << b for b in bits)
    return unit, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit word."""
    unit, errors = _code()
    syndrome = np.zeros(words.shape, np.uint32)
    for bit in range(23):
        syndrome ^= (words >> np.uint32(bit) & np.uint32(1)) * unit[bit]
    return (words ^ errors[syndrome]) >> np.uint32(11)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): the distinct keys of each 64-bit fingerprint."""
    near = np.array([0, *(1 << b for b in range(23))], np.uint32)
    cut = [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.uint32) for at, width in SEGMENTS]
    where, keys = [], []
    for n in range(3):
        equal, fuzzy = cut[n], cut[(n + 1) % 3]
        index = np.sort(codeword_index(fuzzy[:, None] ^ near[None, :]), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        row, column = np.nonzero(first)
        where.append(row)
        keys.append(n << 36 | equal[row].astype(np.int64) << 12 | index[row, column].astype(np.int64))
    return np.concatenate(where), np.concatenate(keys)


def simhash(text: str, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the hashes of all word shingles; no word gives 0."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def _print_rows(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        prints = np.array([simhash(t) for t in batch["text"]], np.uint64).view(np.int64)
        yield {"doc_id": batch["doc_id"], "print": prints}


def _key_rows(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        prints = np.array(batch["print"], np.int64)
        where, keys = fuzzy_keys(prints.view(np.uint64))
        yield {"key": keys, "print": prints[where]}


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Pairs (a, b) of distinct 64-bit ``print`` values that connect all that differ in at most two bits.

    Keys with at most ``paired`` members give every pair that passes the exact comparison. The
    members of larger keys are filed under each of their 65 words within one bit: two of them
    differ in at most two bits just when they share such a word, at most 65 can share one, and
    one link to the least of them keeps them connected.
    """
    keys = materialise(map_rows(prints.select("print"), _key_rows, "key long, print long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keys.join(sizes, "key"), "golay-shared")
    small = shared.where(F.col("n") <= paired).select("key", "print")
    pairs = (
        small.select("key", F.col("print").alias("a"))
        .join(small.select("key", F.col("print").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .select("a", "b")
        .distinct()
    )
    near = F.array(F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)))
    crowded = shared.where(F.col("n") > paired).select("print").distinct()
    filed = crowded.select("print", F.explode(near).alias("bit")).select("print", F.col("print").bitwiseXOR(F.col("bit")).alias("word"))
    met = filed.groupBy("word").agg(F.collect_list("print").alias("members")).where(F.size("members") > 1)
    stars = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, one row per row of ``docs``.

    Fingerprints that differ in at most two bits link their documents; a component is named by
    its smallest id. Null and empty texts have the fingerprint zero, which links like any other.
    Rows with one id keep their own fingerprints. An empty table gives no row; other columns are
    ignored. Copies meet as one fingerprint before anything is compared.
    """
    prints = materialise(map_rows(texts_of(docs), _print_rows, "doc_id long, print long"), "simhashes")
    least = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-simhashes")
    roots = components(links(least))
    named = least.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    named = materialise(named, "simhash-roots")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = prints.join(named.select("print", "root"), "print").join(smallest, "root")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by similarity: prefixes of ordered shingles as keys, exact verification --------

SIMILARITY = 0.8
SIMILAR_SHINGLE = 5
#: Members of a key that are all compared; those of larger keys meet a central member first.
ALL_PAIRS = 16
#: Documents (about) and share of them at least whose shingles are counted to put frequent ones last, the least count
#: of a frequent one, and how many are held. They set the order of shingles only: any order finds all pairs, a good one
#: has small keys. A share, as shingles that too small a sample misses make keys that grow with the corpus.
ORDER_SAMPLE = 10_000
ORDER_SHARE = 0.2
FREQUENT = 4
HELD_FREQUENT = 1 << 20


def shingle_set(text: str, size: int = SIMILAR_SHINGLE) -> set[tuple[bytes, ...]]:
    words = text.encode().lower().split()
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else {tuple(words)}


def shingle_hashes(text: str, size: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of :func:`shingle_set`."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode().lower().split()
    if len(words) < size:
        return np.array([digest(b" ".join(words), len(words) + 1)], np.uint64)
    own = np.array([digest(w) for w in words], np.uint64)
    hashes = np.zeros(len(words) - size + 1, np.uint64)
    for n in range(size):
        hashes = (hashes ^ own[n : n + len(hashes)]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return np.unique(hashes)


def often(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return np.where(frequent[at] == hashes, counts[at], 0)


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a document: frequent ones come last, then the hash decides.

    Two sets whose similarity is 0.8 share at least 0.8 of the larger one; where all sets are ordered
    alike, the least shared element lies within the first n - ceil(0.8 n) + 1 elements of both.
    """
    n = len(hashes)
    return hashes[np.lexsort((hashes, often(hashes, frequent, counts)))][: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]


def _shingle_rows(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        for text in batch["text"]:
            yield {"key": shingle_hashes(text).view(np.int64)}


def _frequent(texts: DataFrame):
    """Broadcast (hashes, counts) of the most frequent shingles of a sample of the documents."""
    share = min(1.0, max(ORDER_SHARE, ORDER_SAMPLE / max(texts.count(), 1)))
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).select("text")
    counted = map_rows(some, _shingle_rows, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.desc("n"), "key").limit(HELD_FREQUENT).toPandas()
    hashes, counts = rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return texts.sparkSession.sparkContext.broadcast((hashes[order], counts[order]))


def _prefix_rows(frequent):
    """Digest of the words, fingerprint, number of shingles and prefix of each text."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        import hashlib

        for batch in batches:
            out = {"id": batch["id"], "digest": [], "print": [], "size": [], "keys": []}
            for text in batch["text"]:
                hashes = shingle_hashes(text)
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                votes = bits.sum(axis=0, dtype=np.int64)
                out["digest"].append(hashlib.sha256(b" ".join(text.encode().lower().split())).digest()[:16])
                out["print"].append(int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0]))
                out["size"].append(len(hashes))
                out["keys"].append(prefix(hashes, *frequent.value).view(np.int64))
            yield out

    return rows


def _similar_rows(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        kept_a, kept_b, last, own = [], [], None, set()
        for a, b, left, right in zip(batch["a"], batch["b"], batch["left"], batch["right"]):
            if a != last:
                last, own = a, shingle_set(left)
            other = shingle_set(right)
            both = len(own & other)
            if both >= SIMILARITY * (len(own) + len(other) - both) - 1e-9:
                kept_a.append(a)
                kept_b.append(b)
        yield {"a": kept_a, "b": kept_b}


def _central(members: DataFrame) -> DataFrame:
    """(key, centre): the member nearest to what most fingerprints of the key say, bit by bit.

    Of copies that were each changed a little, it is the original if that is among them.
    """
    both = F.lit((1 << 32) | 1)  # two bits are counted in one long
    sums = [F.sum(F.shiftrightunsigned("print", n).bitwiseAND(both)).alias(f"v{n}") for n in range(32)]
    votes = members.groupBy("key").agg(F.count("*").alias("size"), *sums)
    most = F.lit(0).cast("long")
    for n in range(32):
        low = (F.col(f"v{n}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("size")).cast("long")
        high = (F.shiftrightunsigned(f"v{n}", 32) * 2 > F.col("size")).cast("long")
        most = most.bitwiseOR(F.shiftleft(low, n)).bitwiseOR(F.shiftleft(high, n + 32))
    away = F.bit_count(F.col("print").bitwiseXOR(F.col("most")))
    near = members.join(votes.select("key", most.alias("most")), "key").groupBy("key").agg(F.min(F.struct(away, "id")).alias("best"))
    return near.select("key", F.col("best.id").alias("centre"))


def _possible_rows(frequent):
    """Pairs that may be similar: what one prefix lacks of the other, up to where both reach, is in one text only."""

    def lacks(own: np.ndarray, other: np.ndarray) -> int:
        counts, last = often(own, *frequent.value), int(often(other[-1:], *frequent.value)[0])
        reached = (counts < last) | (counts == last) & (own <= other[-1])
        return int((reached & ~np.isin(own, other)).sum())

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            kept = []
            for k, (n, m, single) in enumerate(zip(batch["size_a"], batch["size_b"], batch["single"])):
                if not single:
                    kept.append(k)
                    continue
                a, b = (np.array(batch[c][k], np.int64).view(np.uint64) for c in ("keys_a", "keys_b"))
                if min(n - lacks(a, b), m - lacks(b, a)) >= SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-6:
                    kept.append(k)
            yield {c: [batch[c][k] for k in kept] for c in ("a", "b")}

    return rows


def _possible(pairs: DataFrame, classes: DataFrame, frequent) -> DataFrame:
    """The pairs without those whose sizes and prefixes rule out similarity; a pair whose id has several texts stays.

    Sizes are compared first, so that prefixes travel with the pairs of texts of about the same size only; they
    go straight to the comparison and are not written.
    """
    one = classes.groupBy("id").agg(F.count("*").alias("texts"), F.min(F.struct("size", "keys")).alias("first"))
    one = one.select("id", "texts", "first.*")
    sizes = classes.groupBy("id").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    side = lambda df, end: df.select(*(F.col(c).alias(end if c == "id" else f"{c}_{end}") for c in df.columns))
    sized = pairs.join(side(sizes, "a"), "a").join(side(sizes, "b"), "b")
    fits = (F.col("most_a") >= SIMILARITY * F.col("least_b") - 1e-6) & (F.col("most_b") >= SIMILARITY * F.col("least_a") - 1e-6)
    near = materialise(sized.where(fits).select("a", "b"), "sized-pairs")
    both = near.join(side(one, "a"), "a").join(side(one, "b"), "b")
    both = both.withColumn("single", (F.col("texts_a") == 1) & (F.col("texts_b") == 1))
    kept = map_rows(both.select("a", "b", "single", "size_a", "size_b", "keys_a", "keys_b"), _possible_rows(frequent), "a long, b long")
    kept = materialise(kept, "possible-pairs")
    release(pairs.sparkSession, near)
    return kept


def _bodies(ids: DataFrame, texts: DataFrame) -> DataFrame:
    chosen = texts.join(ids.distinct().hint("merge"), "id", "left_semi")  # one plan at every size
    bodies = materialise(chosen.groupBy("id").agg(F.min("text").alias("text")), "candidate-texts")
    release(texts.sparkSession)
    return bodies


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose texts are similar."""
    left = pairs.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(bodies.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    found = materialise(map_rows(both.select("a", "b", "left", "right"), _similar_rows, "a long, b long"), "similar-pairs")
    release(pairs.sparkSession)
    return found


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the ``root`` of their ``id``."""
    return nodes.join(components(links), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")


def fuzzy_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of ids that connect all whose ``print`` values differ in at most two bits (see :func:`links`)."""
    prints = materialise(classes.groupBy("print").agg(F.min("id").alias("least")), "class-prints")
    end = lambda name: prints.select(F.col("print").alias(name), F.col("least").alias(f"id_{name}"))
    near = links(prints).join(end("a"), "a").join(end("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    same = classes.join(prints, "print").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    return near.union(same).where("a <> b")


def _grouped(texts: DataFrame) -> DataFrame:
    """(id, root) of ``texts`` (id, text), linked by five-word shingles with a similarity of at least 0.8.

    Texts with the same words in the same order meet first, whatever their number, and are
    represented by their least id. Candidates are the pairs that SimHash and Golay keys link and, as fingerprints of
    similar texts may differ in more bits, the pairs that share a shingle key (see :func:`prefix`); all similar
    pairs do. Both are verified on whole texts. The members of a large key meet its central member first; then the
    pairs of the key that are not connected by then are compared if it can be the first shingle they share, so no link is missed.
    """
    spark, frequent = texts.sparkSession, _frequent(texts)
    release(spark)
    found = materialise(
        map_rows(texts, _prefix_rows(frequent), "id long, digest binary, print long, size int, keys array<long>"), "prefixes"
    )
    first = F.min(F.struct("id", "print", "size", "keys")).alias("first")
    classes = materialise(found.groupBy("digest").agg(first).select("digest", "first.*"), "word-classes")
    digests = materialise(found.select("id", "digest"), "digests")
    release(spark, found)
    keys = classes.select("id", "size", F.posexplode("keys").alias("at", "key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    counts = materialise(counts, "prefix-counts")
    shared = materialise(keys.join(counts.where("n > 2").select("key", "n"), "key"), "shared-prefixes")
    sets = shared.where(F.col("n") <= ALL_PAIRS).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids").distinct()
    firsts = sets.select("ids", F.posexplode("ids").alias("at", "a"))
    every = firsts.select("a", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("b"))
    known = classes.groupBy("id").agg(F.min("print").alias("print"))
    large = materialise(shared.where(F.col("n") > ALL_PAIRS).join(known, "id"), "large-prefixes")
    own = large.groupBy("id").agg(F.max(F.struct("n", "key")).alias("most")).select("id", F.col("most.key").alias("key"))
    stars = own.join(_central(large), "key").where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))
    pairs = materialise(counts.where("n = 2").select("a", "b").union(every).union(stars).union(fuzzy_pairs(classes)).distinct(), "candidate-pairs")
    release(spark, shared)
    pairs = _possible(pairs, classes, frequent)
    bodies = _bodies(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("id")), texts)
    found_links = _verified(pairs, bodies)
    rooted = materialise(_rooted(large.select("key", "id", "size", "at"), found_links), "large-keys")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    apart = materialise(rooted.join(mixed, "key", "left_semi"), "mixed-keys")
    other = apart.select("key", F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("at").alias("at_b"), F.col("root").alias("root_b"))
    fits = (F.col("size") >= SIMILARITY * F.col("size_b") - 1e-6) & (F.col("size_b") >= SIMILARITY * F.col("size") - 1e-6)
    # As the first shared shingle, a key leaves no more to share than what comes from it on in either text.
    left = F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b"))
    first_shared = left >= SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("size_b")) - 1e-6
    rest = apart.withColumnRenamed("id", "a").join(other, "key").where((F.col("root") < F.col("root_b")) & fits & first_shared)
    rest = materialise(rest.select("a", "b").distinct(), "remaining-pairs")
    if rest.take(1):
        rest = _possible(rest, classes, frequent)
        found_links = found_links.union(_verified(rest, bodies))
    release(spark, bodies, rooted, apart)
    named = _rooted(classes.select("digest", "id"), found_links)
    groups = materialise(digests.join(named.select("digest", "root"), "digest").select("id", "root"), "groups")
    release(spark, classes, digests, counts, large, pairs)
    return groups


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of texts linked by five-word shingles with a similarity of at least 0.8.

    Rows that share an id are one document here; null ids get no group.
    """
    texts = texts_of(docs).where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    return _grouped(texts).select(F.col("id").alias("doc_id"), F.col("root").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: the document with the smallest id of each group of :func:`similar_groups`.

    Rows with one id count as one document, the one with the least text; so do rows without an id.
    """
    others = similar_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    kept = docs.join(others.hint("merge"), "doc_id", "left_anti").withColumn("__rank", rank).where("__rank = 1")
    return kept.select(*docs.columns)


def keep_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, whatever the rows' ids: the least id, null ids last.

    A row is known by 128 bits of hashes of all its columns and of which are null; of rows that
    are equal in all columns, which are copies, one stays. Groups are those of texts only, so rows
    without an id or with an id in common are kept where their texts differ.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    flags = [c.isNull() for c in columns]
    marks = [F.xxhash64(F.lit(n), *columns, *flags).alias(f"__mark{n}") for n in (1, 2)]
    marked = docs.select("*", *marks)
    texts = marked.select(F.col("__mark1").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    named = materialise(marked.select("doc_id", "__mark1", "__mark2"), "row-marks")
    joined = named.join(_grouped(texts).distinct(), F.col("__mark1") == F.col("id"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__mark1", "__mark2")).alias("best")
    kept = joined.groupBy("root").agg(best).select("best.__mark1", "best.__mark2").distinct()
    rank = F.row_number().over(Window.partitionBy("__mark1", "__mark2").orderBy("doc_id"))
    once = marked.withColumn("__rank", rank).where("__rank = 1")
    return once.join(kept.hint("merge"), ["__mark1", "__mark2"], "left_semi").select(*docs.columns)
