"""Near-dedup keeps its keys small as the corpus grows and leaves no spent tables behind."""

from __future__ import annotations

import os
import random

from wiretally.llm import golay_dedup as g
from wiretally.session import shared_dir

PASSAGE = "a passage that one in seven of all these texts holds somewhere in its midst"


def texts_of_a_shared_passage(count: int) -> list[tuple[int, str]]:
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = []
    for n in range(count):
        words = [word() for _ in range(40)]
        rows.append((n, " ".join(words[:20] + ([PASSAGE] if n % 7 == 0 else []) + words[20:])))
    return rows


def test_frequent_shingles_are_found_in_a_share_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(g, "ORDER_SAMPLE", 20)
    texts = spark.createDataFrame(texts_of_a_shared_passage(700), "id long, text string")
    hashes, counts = g._frequent(texts).value
    assert set(g.shingle_hashes(PASSAGE)) <= set(hashes) and counts.min() >= g.FREQUENT


def test_spent_tables_are_deleted(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = texts_of_a_shared_passage(140)
    rows += [(1000 + n, t + " and one word more") for n, t in rows[:20]] + [(2000, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in g.keep_rows(docs).collect()) == list(range(140))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert not left & {"prefixes", "word-classes", "shared-prefixes", "large-prefixes", "candidate-texts", "sized-pairs"}, left
