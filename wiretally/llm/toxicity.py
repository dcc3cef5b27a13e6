"""Toxicity scores of texts whose words may be disguised.

Disguised stretches (look-alike signs, stretched letters, letters set apart) become lattices of
characters; a Viterbi search under a character trigram model of the corpus picks the likeliest
reading. Scores come from the words of the plain and the restored text: every word and word
beginning has a lower bound of the share of toxic documents among training documents with it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import fold, map_rows
from wiretally.llm.language_id import LETTERS, letter_table
from wiretally.session import materialise

#: Labelled rows that are learned from: at most this many, those with the least hashes of their ids.
SAMPLE = 60_000
#: The least bound of a word or beginning that the model keeps, and the lengths of beginnings.
LEAST_BOUND = 0.45
BEGINNINGS = (4, 5, 6)
#: Toxic training documents that a feature needs, and standard errors below its share that count.
LEAST_TOXIC = 4
ERRORS = 2.5
#: Rounds in which features are dropped that mostly decide wrongly, and the share of right decisions that keeps one.
ROUNDS = 3
LEAST_RIGHT = 0.5
#: Share of the base rate that a text without any feature scores.
BASE = 0.25
THRESHOLD = 0.3
#: Signs and the letters that they may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "il", "|": "il"}
#: Letters of other scripts that look like Latin ones, and signs without width.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
NO_WIDTH = dict.fromkeys((0x00AD, 0x034F, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
#: What an emitted letter gains, so that shorter readings are not preferred for having fewer letters.
LETTER_GAIN = 1.9
#: Readings of stretches that a worker remembers, and the longest stretch that it does; others are decoded anew.
REMEMBERED = 50_000
REMEMBERED_LENGTH = 40
#: Pairs that a task counts before it hands over partial sums.
HELD = 500_000

WORDS = re.compile(r"[^\W\d_]+")
SIGNS = re.compile(r"[0134570@$!|]")
SIGNED = re.compile(r"(?<![^\W_])[^\W\d_]*[013457@$!|]+(?:[^\W_]|[@$!|])*")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
APART = re.compile(r"(?<![\w@$!|])(?:[^\W_@$!|][ .\-_*]|[@$!|][ .\-_*]){2,}(?:[^\W_]|[@$!|])(?![\w@$!|])")
#: The end of every stretch that APART finds, NO_WIDTH signs and HOMOGLYPHS: quick to look for, and mostly absent.
APART_END = re.compile(r"[ .\-_*](?:[^\W_]|[@$!|])[ .\-_*](?:[^\W_]|[@$!|])(?![\w@$!|])")
ANY_NO_WIDTH = re.compile(f"[{''.join(map(chr, NO_WIDTH))}]")
ANY_HOMOGLYPH = re.compile(f"[{''.join(HOMOGLYPHS)}]")
LONG_RUN = re.compile(r"(.)\1{2,}")


class Letters:
    """Trigram log probabilities of letters; 0 stands between words."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
        single = (table.sum(axis=(0, 1)) + 0.5) / (table.sum() + 0.5 * LETTERS)
        pairs = table.sum(axis=0)
        double = (pairs + 20 * single) / (pairs.sum(axis=1, keepdims=True) + 20)
        triple = (table + 20 * double[None]) / (table.sum(axis=2, keepdims=True) + 20)
        self.logs = np.log(triple).astype(np.float32)
        self.read: dict[tuple[str, bool], list[str]] = {}


def lattice(stretch: str) -> list[list[str]]:
    """Per run of equal characters, the letters that it may stand for; separators stand for none."""
    out = []
    for sign, run in groupby(stretch):
        n = sum(1 for _ in run)
        if sign in " .-_*":
            continue
        letters = LOOKALIKES.get(sign) or sign + HOMOGLYPHS.get(sign, "")
        out.append([c * k for c in letters for k in ((1, 2) if n > 1 else (1,))])
    return out


def decode(stretch: str, letters: Letters, classes: np.ndarray, breaks: bool = False) -> str:
    """The likeliest word behind a disguised stretch (in lower case), or words if ``breaks`` may come after letters.

    Takes time and memory in proportion to the stretch: states are pairs of letters, readings are chains of choices.
    """
    logs = letters.logs
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    steps = lattice(stretch)
    if breaks:
        steps = [[*choices, *(c + " " for c in choices)] for choices in steps[:-1]] + steps[-1:]
    for choices in [*steps, [""]]:
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, chain) in best.items():
            for choice in choices:
                x, y, total = a, b, score
                for c in choice or "\n":
                    z = int(classes[ord(c)]) if ord(c) < len(classes) else 0
                    total += float(logs[x, y, z]) + (LETTER_GAIN if choice and c != " " else 0)
                    x, y = y, z
                if (x, y) not in after or after[x, y][0] < total:
                    after[x, y] = (total, (chain, choice))
        best = after
    chain = max(best.values(), key=lambda found: found[0])[1]
    parts = []
    while chain:
        chain, choice = chain
        parts.append(choice)
    return "".join(reversed(parts))


def _core(signed: str) -> str:
    """A stretch with signs, without those that stress it at its ends, and no run longer than two."""
    core = signed.lstrip("!|")
    if core[-1:] in ("!", "|"):
        core = core.rstrip("!|")
    elif core[-1:] in ("$", "@") and core[-3:] == core[-1:] * 3:
        core = core.rstrip(core[-1])
    return LONG_RUN.sub(r"\1\1", core)


def disguised(lower: str) -> Iterator[tuple[str, bool]]:
    """Stretches of a lower-case text that need decoding, of any length, and whether they may be several words."""
    if SIGNS.search(lower):
        for m in SIGNED.finditer(lower):
            core = _core(m[0])
            if len(core) >= 3 and not core.isalpha() and sum(c.isalpha() for c in core) * 3 >= len(core):
                if all(c.isalpha() or c in LOOKALIKES for c in core):
                    yield core, False
    end = 0
    for m in STRETCHED.finditer(lower):
        if m.start() >= end:
            start, end = m.span()
            while start and lower[start - 1].isalpha():
                start -= 1
            while end < len(lower) and lower[end].isalpha():
                end += 1
            yield LONG_RUN.sub(r"\1\1", lower[start:end]), False
    for m in APART.finditer(lower) if APART_END.search(lower) else ():
        if sum(c.isalpha() for c in m[0]) * 4 > len(m[0]):
            yield m[0], True
    if not lower.isascii() and ANY_HOMOGLYPH.search(lower):
        for word in WORDS.findall(lower):
            if not word.isascii() and any(c in HOMOGLYPHS for c in word) and any("a" <= c <= "z" for c in word):
                yield LONG_RUN.sub(r"\1\1", word), False


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(letter_table())
    return _CLASSES[0]


def readings(stretch: str, breaks: bool, letters: Letters) -> list[str]:
    """Words behind a stretch; short stretches are remembered, as the same ones come again and again."""
    if len(stretch) > REMEMBERED_LENGTH:
        return decode(stretch, letters, classes(), breaks).split()
    found = letters.read.get((stretch, breaks))
    if found is None:
        if len(letters.read) >= REMEMBERED:
            letters.read.clear()
        found = letters.read[stretch, breaks] = decode(stretch, letters, classes(), breaks).split()
    return found


def restored_words(text: str, letters: Letters) -> set[str]:
    """Distinct words of the text, and of its disguised stretches once decoded."""
    lower = text.lower()
    if not lower.isascii() and ANY_NO_WIDTH.search(lower):
        lower = lower.translate(NO_WIDTH)
    words = set(WORDS.findall(lower))
    for stretch, breaks in set(disguised(lower)):
        words.update(readings(stretch, breaks, letters))
    return words


def features(words: set[str]) -> set[str]:
    found = {w for w in words if len(w) > 2}
    for n in BEGINNINGS:
        found |= {w[:n] + "*" for w in words if len(w) > n}
    return found


def _letter_rows(batches: Iterator[dict]) -> Iterator[dict]:
    counts = np.zeros(LETTERS**3, np.int64)
    table = classes()
    for batch in batches:
        for text in batch["text"]:
            points = np.frombuffer(("\n\n" + text.lower() + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            own = table[np.where(points < 1 << 16, points, 0)].astype(np.int64)
            codes = (own[:-2] * LETTERS + own[1:-1]) * LETTERS + own[2:]
            counts += np.bincount(codes, minlength=LETTERS**3)
    used = np.nonzero(counts)[0]
    yield {"code": used, "n": counts[used]}


def train_letters(texts: DataFrame):
    """Broadcast trigram model over all ``text`` values: at most 64 to the third counts."""
    counted = map_rows(texts.select("text"), _letter_rows, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(LETTERS**3)
    counts[counted["code"].to_numpy()] = counted["n"].to_numpy()
    return texts.sparkSession.sparkContext.broadcast(Letters(counts))


def _sketch_rows(batches: Iterator[dict]) -> Iterator[dict]:
    """The least hash of three neighbouring words: (nearly) equal for (near) copies."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        marks = []
        for text in batch["text"]:
            words = text.encode().lower().split()
            marks.append(min(map(digest, map(b" ".join, zip(words, words[1:], words[2:]))), default=0) - (1 << 63))
        yield {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "mark": marks}


def sample_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic) of at most ``sample`` labelled documents outside the held-out fold, one of each group of copies."""
    known = labels.where(fold(4) != 2).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = map_rows(rows.join(F.broadcast(chosen), "doc_id"), _sketch_rows, "doc_id long, toxic int, mark long")
    return marked.groupBy("mark").agg(F.min(F.struct("doc_id", "toxic")).alias("one")).select("one.*").distinct().limit(sample)


def train_features(docs: DataFrame, labels: DataFrame, letters, sample: int = SAMPLE):
    """Broadcast (weights of features, score without any) learned from the sampled labels."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sampled = materialise(sample_labels(docs, labels, sample), "toxic-sample")
    labelled = rows.join(F.broadcast(sampled), "doc_id").select("text", "toxic")

    def count(batches):
        held: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def out():
            return {"feature": list(held), "toxic": [v[0] for v in held.values()], "n": [v[1] for v in held.values()]}

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for feature in features(restored_words(text, letters.value)):
                    pair = held[feature]
                    pair[0] += toxic == 1
                    pair[1] += 1
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    counted = map_rows(labelled, count, "feature string, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    share = F.col("toxic") / F.col("n")
    z2 = ERRORS**2
    bound = (share + z2 / (2 * F.col("n")) - ERRORS * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") ** 2))) / (1 + z2 / F.col("n"))
    counted = counted.withColumn("bound", bound)
    best = counted.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("bound") >= LEAST_BOUND))
    # At most a fourth of the words of the sampled toxic texts.
    weights = {r["feature"]: float(r["bound"]) for r in best.select("feature", "bound").collect()}
    base = sampled.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    weights = _without_followers(labelled, letters, weights)
    return docs.sparkSession.sparkContext.broadcast((weights, min(BASE * base, THRESHOLD / 2)))


def _without_followers(labelled: DataFrame, letters, weights: dict[str, float]) -> dict[str, float]:
    """Drop features that owe their share to stronger ones in the same documents.

    A beginning that toxic words share with harmless ones looks toxic as long as the toxic words
    themselves count for it. Each training document is decided by its strongest feature; one
    that mostly decides wrongly goes, and the rest decide anew.
    """

    def keep(batches):
        for batch in batches:
            found = [sorted(features(restored_words(t, letters.value)) & weights.keys()) for t in batch["text"]]
            yield {"toxic": batch["toxic"], "found": found}

    known = materialise(map_rows(labelled, keep, "toxic int, found array<string>").where(F.size("found") > 0), "toxic-features")
    for _ in range(ROUNDS):
        held = dict(weights)

        def decide(batches, held=held):
            for batch in batches:
                best = [max((f for f in found if f in held), key=lambda f: (held[f], f), default="") for found in batch["found"]]
                yield {"toxic": batch["toxic"], "feature": best}

        decided = map_rows(known, decide, "toxic int, feature string").groupBy("feature").agg(
            F.avg((F.col("toxic") == 1).cast("int")).alias("right")
        )
        wrong = {r["feature"] for r in decided.where(F.col("right") < LEAST_RIGHT).collect()}
        if not wrong & weights.keys():
            break
        weights = {f: w for f, w in weights.items() if f not in wrong}
    return weights


def score(docs: DataFrame, letters, model) -> DataFrame:
    """``doc_id``, ``score`` and ``n_features`` of every row; a text without any known word gets the base score."""

    def rows(batches):
        weights, base = model.value
        for batch in batches:
            scores, numbers = [], []
            for text in batch["text"]:
                found = [weights[f] for f in features(restored_words(text, letters.value)) & weights.keys()]
                scores.append(max(found, default=base))
                numbers.append(len(found))
            yield {"doc_id": batch["doc_id"], "score": scores, "n_features": numbers}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(texts, rows, "doc_id long, score double, n_features long")


def held_out() -> Column:
    return F.coalesce(fold(4) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Scores of all rows of ``docs``, learned from labels outside the held-out fold.

    Null texts count as empty and get the base score; rows with one id are scored each; a
    document with several labels is toxic if one says so; other columns are ignored; an empty
    table gives no row, and without labels every score is 0.
    """
    letters = train_letters(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    model = train_features(docs, labels, letters, sample)
    found = score(docs, letters, model)
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_features"
    )
