"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

Each window of as many words as an item has gets a SimHash of its word shingles. Fingerprints
are cut into blocks; within the radius, some block differs in at most radius / blocks bits, so
items filed under all block values that near are found without fail. Candidates are verified by
the weighted Jaccard similarity of the shingles (weights are how often they occur).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import map_rows, texts_of

SHINGLE = 5
SIMILARITY = 0.8
#: Bits that fingerprints may differ in: beyond what windows of the least similarity show, by some standard errors.
RADIUS = 24
BLOCKS = 8
#: Words of items that are held at once; larger benchmarks are taken in several passes.
ITEM_WORDS = 2_000_000
#: Words whose hashes a task remembers.
MEMO = 1_000_000
WORDS = re.compile(r"\w+")
#: Odd multipliers that tell the places of a shingle apart.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)

MATCHES = "doc_id long, item_id long, start_word long, n_words long, distance long, similarity double"


class Hashes(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: str, hashes: Hashes) -> np.ndarray:
    words = WORDS.findall(text.lower())
    return np.fromiter((hashes[w] for w in words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    count = max(len(words) - size + 1, 0)
    total = np.zeros(count, np.uint64)
    for n in range(size):
        total += (words[n : n + count] ^ (words[n : n + count] >> np.uint64(29))) * PLACES[n]
    total ^= total >> np.uint64(32)
    return total * PLACES[0]


def simhash(hashes: np.ndarray) -> int:
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    left, right = Counter(a.tolist()), Counter(b.tolist())
    both = sum((left & right).values())
    return both / (len(a) + len(b) - both)


class Items:
    """Items by number of words, filed under every block value near their fingerprints' blocks."""

    def __init__(self, rows: list[tuple[int, str]]):
        hashes = Hashes()
        self.bits = 64 // BLOCKS
        near = [sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(self.bits), k)]
        self.lengths: dict[int, dict] = {}
        known: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in rows:
            words = word_hashes(text or "", hashes)
            if not len(words):
                continue
            size = min(SHINGLE, len(words))
            own = shingles(words, size)
            known[size].append(own)
            at = self.lengths.setdefault(len(words), {"size": size, "items": [], "files": defaultdict(list)})
            value = simhash(own)
            for n in range(BLOCKS):
                block = value >> n * self.bits & (1 << self.bits) - 1
                for change in near:
                    at["files"][n, block ^ change].append(len(at["items"]))
            at["items"].append((item, own, value))
        self.known = {size: np.unique(np.concatenate(found)) for size, found in known.items()}
        self.marks = {size: np.bincount((v >> np.uint64(44)).astype(np.int64), minlength=1 << 20) > 0 for size, v in self.known.items()}

    def members(self, values: np.ndarray, size: int) -> np.ndarray:
        """Which shingles occur in any item."""
        found = self.marks[size][(values >> np.uint64(44)).astype(np.int64)]
        where = np.nonzero(found)[0]
        known = self.known[size]
        place = np.minimum(np.searchsorted(known, values[where]), len(known) - 1)
        found[where] = known[place] == values[where]
        return found

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(item, start, words, distance, similarity) of each item's best window in a document, where similar enough."""
        inside = {}
        for size in self.known:
            values = shingles(words, size)
            member = self.members(values, size)
            if member.any():
                inside[size] = values, np.concatenate([[0], np.cumsum(member)])
        for length, at in self.lengths.items():
            if at["size"] not in inside:
                continue
            values, sums = inside[at["size"]]
            full = length - at["size"] + 1
            count = min(full, len(values))
            # The windows that share enough shingles with items at all: others cannot be similar to one.
            least = SIMILARITY * (full + count) / (1 + SIMILARITY) - 1e-9
            starts = np.nonzero(sums[count:] - sums[: len(sums) - count] >= least)[0]
            best: dict[int, tuple[float, int, int]] = {}
            for start in starts.tolist():
                window = values[start : start + count]
                value = simhash(window)
                met = set()
                for n in range(BLOCKS):
                    met.update(at["files"].get((n, value >> n * self.bits & (1 << self.bits) - 1), ()))
                for k in met:
                    distance = (value ^ at["items"][k][2]).bit_count()
                    if distance <= RADIUS:
                        similarity = weighted_jaccard(window, at["items"][k][1])
                        if similarity >= SIMILARITY and (k not in best or similarity > best[k][0]):
                            best[k] = (similarity, start, distance)
            for k, (similarity, start, distance) in best.items():
                yield at["items"][k][0], start, count + at["size"] - 1, distance, similarity


def item_blocks(benchmark: DataFrame, item_words: int = ITEM_WORDS) -> Iterator:
    """Broadcasts of :class:`Items` that together hold the whole benchmark, each of about ``item_words`` words at most."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = rows.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    blocks = int(words // item_words) + 1
    for n in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        found = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r))
        yield spark.sparkContext.broadcast(Items(found))


def find(docs: DataFrame, benchmark: DataFrame, item_words: int = ITEM_WORDS) -> DataFrame:
    """One row per document and benchmark item that it holds: the best window, in words, and its similarity.

    Null and empty texts and items match nothing; items that share a text, and rows that share
    an id, are reported each; of equally similar windows the first counts; documents without a
    match give no row. Other columns are ignored. An item of fewer than five words is one
    shingle. Several passes are made over ``docs`` where the benchmark is large.
    """
    found = None
    for items in item_blocks(benchmark, item_words):

        def rows(batches, items=items):
            hashes = Hashes()
            for batch in batches:
                out = {c.split()[0]: [] for c in MATCHES.split(", ")}
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    for match in items.value.matches(word_hashes(text, hashes)):
                        for column, value in zip(out.values(), (doc, *match)):
                            column.append(value)
                yield out

        part = map_rows(texts_of(docs), rows, MATCHES)
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, item_words: int = ITEM_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for items in item_blocks(benchmark, item_words):

        def rows(batches, items=items):
            hashes = Hashes()
            for batch in batches:
                clean = [next(items.value.matches(word_hashes(t or "", hashes)), None) is None for t in batch["text"]]
                yield {name: [v for v, c in zip(column, clean) if c] for name, column in batch.items()}

        docs = map_rows(docs, rows, schema)
    return docs
