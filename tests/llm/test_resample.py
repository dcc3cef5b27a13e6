from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from wiretally.llm import resample as r


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams(text, shortest=1, longest=1):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, shortest=1, longest=1, buckets=10_000, least_words=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in grams(t, shortest, longest))
    t = Counter(bucket(f) for x in target for f in grams(x, shortest, longest))
    total, aimed = float(s.total()), float(t.total())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aimed + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        own = [gain[bucket(f)] for f in grams(text, shortest, longest)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(words_of(text)), len(own), weight, score))
    fit = sorted((x for x in rows if x[1] >= least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    best = fit[: percent * len(fit) // 100]
    return sorted([(*x, n + 1) for n, x in enumerate(best)], key=str), sorted(rows, key=str)


def rows_of(df):
    found = [(x.doc_id, x.n_words, x.n_features, x.weight, x.score, x["rank"]) for x in df.collect()]
    drawn = sorted([x for x in found if x[5] is not None], key=str)
    return drawn, sorted([x[:5] for x in found], key=str)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_against_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    got = entry.queries()["op12_resample"](spark, folder).toArrow()
    assert compare(got, connect(folder).execute(entry.oracle_sql()["op12_resample"]).to_arrow_table()) is None


@pytest.mark.parametrize("shortest,longest", [(1, 1), (1, 3), (2, 2)])
def test_against_brute_force(spark, shortest, longest):
    rng = random.Random(longest)
    texts = [" ".join(rng.choice(["Étoile", "ice", "HALF", "naïve", "x1", "7"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = [(n, t) for n, t in enumerate(texts)] + [(None, texts[3]), (None, None), (5, texts[9]), (5, texts[5]), (5, texts[5])]
    docs += [(900, ""), (901, None), (902, "...---"), (903, "A\x7fB\x00C İI ǅ"), (904, "word, " * 300_000), (905, "x" * 3_000_000)]
    target = ["ice x1 ice", None, "", "HALF half Étoile"]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, rank string, gains int").repartition(7)
    aim = spark.createDataFrame([(n, t, "z") for n, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = r.resample(df, aim, shortest, longest, buckets=97, percent=30)
    assert rows_of(got) == brute(docs, target, shortest, longest, buckets=97, percent=30)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 9), (2, "a")], "doc_id long, text string")
    aim = spark.createDataFrame([(1, "c")], "item_id long, text string")
    assert r.resample(docs.limit(0), aim).collect() == []
    assert rows_of(r.resample(docs, aim.limit(0), percent=100)) == brute([(1, "a b c " * 9), (2, "a")], [], percent=100)


def test_equal_rows_are_ranked_apart(spark):
    docs = spark.createDataFrame([(3, "a b " * 20)] * 40, "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame([(1, "c")], "item_id long, text string")
    assert sorted(x["rank"] for x in r.resample(docs, aim, percent=50).collect() if x["rank"]) == list(range(1, 21))


@pytest.mark.parametrize("seed", range(20))
def test_pieces_do_not_change_features(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abZ é.\n1") for _ in range(400))
    whole = r.feature_counts(text, 1, 3, 1000, {})
    assert whole == r.feature_counts(text, 1, 3, 1000, {}, piece_bytes=rng.randint(1, 40))
    assert whole[1] == Counter(zlib.crc32(f.encode()) % 1000 for f in grams(text, 1, 3))


def test_offsets_are_code_points():
    (piece, pairs), *rest = r.words_with_offsets("É a-Bc")
    assert not rest and [piece[a:b] for a, b in pairs] == ["É", "a", "bc"] and pairs == [(0, 1), (2, 3), (4, 6)]
