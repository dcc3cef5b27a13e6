from __future__ import annotations

import random
import time
import zlib

import numpy as np

import __spark_entry__ as entry
from wiretally.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = entry.queries()["op4_toxicity"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    hits = sum(p and t for p, t in held)
    assert hits >= 0.8 * sum(t for _, t in held)
    assert hits >= 0.9 * sum(p for p, _ in held)


def letters_of(text):
    counts = np.zeros(toxicity.LETTERS**3)
    for row in toxicity._letter_rows(iter([{"text": [text]}])):
        counts[row["code"]] = row["n"]
    return toxicity.Letters(counts)


def test_decoding_restores_words():
    letters = letters_of("such an idiot and a loser they said what a stupid clown scum trash moron good hello letter " * 50)
    for disguise, word in (("1d10t", "idiot"), ("l0ser", "loser"), ("$tup1d", "stupid"), ("i d i o t", "idiot"), ("clooooown", "clown"), ("s.c.u.m", "scum"), ("tr@sh", "trash"), ("m-0-r-0-n", "moron"), ("hellllo", "hello")):
        assert word in toxicity.restored_words(f"so {disguise}, yes", letters), disguise


def test_disguises_of_any_length_and_script():
    letters = letters_of("such an idiot you idiot and a loser they said what a stupid clown you are bad trash moron good hello letter " * 50)
    cases = (
        ("i" + "d" * 40 + "iot", "idiot"),
        ("l0" + "0" * 60 + "ser", "loser"),
        ("i d 1 @ t", None),
        ("i d 1 o t", "idiot"),
        ("$ t u p 1 d", "stupid"),
        ("b a d", "bad"),
        ("y o u i d i o t", "idiot"),
        ("y o u i d i o t", "you"),
        ("m\u043er\u043en", "moron"),
        ("tr\u03b1sh", "trash"),
        ("lo\u200bser", "loser"),
    )
    for disguise, word in cases:
        found = toxicity.restored_words(f"so {disguise}, yes", letters)
        assert word is None or word in found, (disguise, found)
        assert len(found) > 2, disguise
    assert toxicity.restored_words("\u043c\u0430\u043c\u0430 na\u00efve 1000000 3 5 7 9", letters) == {"\u043c\u0430\u043c\u0430", "na\u00efve"}


def test_long_stretches_take_linear_time():
    letters = letters_of("banana bandana cabana an ban nab " * 20)
    started = time.monotonic()
    for text in ("ab" * 100_000 + "aaab", "a!|" * 60_000 + "b", "a " * 100_000 + "b", "!" * 300_000, "b4" * 60_000):
        toxicity.restored_words(text, letters)
    assert time.monotonic() - started < 60


def test_viterbi_is_exact():
    letters, table = letters_of("banana bandana cabana an ban nab " * 20), toxicity.classes()

    def total(word):
        x = y = 0
        score = 0.0
        for c in word:
            z = int(table[ord(c)])
            score += float(letters.logs[x, y, z]) + toxicity.LETTER_GAIN
            x, y = y, z
        return score + float(letters.logs[x, y, 0])

    rng = random.Random(1)
    for _ in range(100):
        stretch = "".join(rng.choice("abn4@aan ") for _ in range(rng.randint(1, 8)))
        readings = [""]
        for choices in toxicity.lattice(stretch):
            readings = [r + c for r in readings for c in choices]
        got = toxicity.decode(stretch, letters, table)
        assert got in readings and abs(total(got) - max(map(total, readings))) < 1e-3


def test_odd_rows(spark):
    rng = random.Random(7)
    words = lambda: " ".join("".join(rng.choice("aeioubdfgmn") for _ in range(5)) for _ in range(30))
    docs = [(n, words() + (" you l0ser go" if n % 5 == 0 else " fine"), "x") for n in range(200)]
    docs += [(900, None, "x"), (901, "", "x"), (None, "a loser", "x"), (902, "pad " * 200_000 + "loser", "x"), (902, "calm", "x")]
    labels = [(n, 1, int(n % 5 == 0)) for n in range(200)] + [(3, None, None), (None, 1, 1)]
    frames = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.classify(*frames).collect()
    assert len(got) == len(docs)
    by = {(r.doc_id, r.predicted) for r in got}
    assert {(900, 0), (901, 0), (902, 1), (902, 0), (None, 1), (0, 1), (1, 0)} <= by
    assert toxicity.classify(frames[0].limit(0), frames[1]).collect() == []
    assert all(r.score == 0 for r in toxicity.classify(frames[0], frames[1].limit(0)).collect())
