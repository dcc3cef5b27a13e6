from __future__ import annotations

import random
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from wiretally.llm import decontaminate as d

SF = "/root/testdata/sf0.001"


def brute(text, item):
    """Best weighted similarity of any item-sized window."""
    words, own = d.WORDS.findall(text.lower()), d.WORDS.findall(item.lower())
    if not words or not own:
        return 0.0
    size = min(5, len(own))
    grams = lambda w: Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    want, best = grams(own), 0.0
    for i in range(max(len(words) - len(own) + 1, 1)):
        got = grams(words[i : i + len(own)])
        union = sum((got | want).values())
        best = max(best, sum((got & want).values()) / union if union else 0.0)
    return best


def test_whole_table_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.similarity for r in entry.queries()["op5_decontaminate"](spark, SF).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in items.items() for w in [d.WORDS.findall(t.lower())]}
    want = {}
    for doc, text in docs.items():
        words = d.WORDS.findall(text.lower())
        shingles = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for item in items:
            if shingles & sets[item] and (similarity := brute(text, items[item])) >= 0.8:
                want[doc, item] = similarity
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_edited_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(n, " ".join(word() for _ in range(rng.choice([3, 15, 40, 59])))) for n in range(20)]
    docs = []
    for n in range(120):
        own = items[rng.randrange(20)][1].split(" ")
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = word()
        docs.append((n, " ".join([word() for _ in range(rng.randint(0, 60))] + own + [word() for _ in range(9)]).upper()))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(n, i): s for n, t in docs for i, x in items if (s := brute(t, x)) >= 0.8}
    for item_words in (d.ITEM_WORDS, 100):
        got = {(r.doc_id, r.item_id): r.similarity for r in d.find(*frames, item_words).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        clean = {r.doc_id for r in d.drop_contaminated(frames[0], frames[1], item_words).collect()}
        assert clean == {n for n, _ in docs} - {n for n, _ in want}


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(0)
    items = d.Items([(n, " ".join(f"w{k}" for k in rng.integers(0, 10**6, 20))) for n in range(30)])
    at = items.lengths[20]
    for _ in range(300):
        k = int(rng.integers(30))
        value = at["items"][k][2]
        for bit in rng.choice(64, int(rng.integers(d.RADIUS + 1)), replace=False).tolist():
            value ^= 1 << bit
        assert any(k in at["files"].get((n, value >> 8 * n & 255), ()) for n in range(d.BLOCKS))


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, f"x {text} y", 1), (3, text, 1), (3, text, 1), (4, "w " * 200_000 + text, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, text), (8, None), (9, ""), (7, text.upper())], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in d.find(docs, items).collect())
    assert got == sorted([(0, 7)] * 2 + [(3, 7)] * 4 + [(4, 7)] * 2)
    assert d.find(docs.limit(0), items).collect() == [] and d.find(docs, items.limit(0)).collect() == []
    clean = d.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2]
