"""The pipeline's near copies pass through the fingerprints and Golay keys of the named method."""

from __future__ import annotations

import random

from wiretally.llm import golay_dedup


def test_golay_keys_name_candidates(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(40)]
    rows = []
    for n, value in enumerate(base):
        rows += [(10 * n + 1, value), (10 * n + 2, value ^ 1 << n | 0), (10 * n + 3, value ^ 1 << n ^ 1 << (n + 20)), (10 * n + 4, value)]
    classes = spark.createDataFrame(rows, "id long, print long")
    found = {frozenset(r) for r in golay_dedup.fuzzy_pairs(classes).collect()}
    for n in range(len(base)):
        reached, new = set(), {10 * n + 1}
        while new:
            reached |= new
            new = {i for pair in found if pair & new for i in pair} - reached
        assert reached == {10 * n + k for k in (1, 2, 3, 4)}


def test_groups_use_the_keys(spark, monkeypatch):
    asked = []
    own = golay_dedup.links
    monkeypatch.setattr(golay_dedup, "links", lambda prints, *more: asked.append(prints.count()) or own(prints, *more))
    docs = spark.createDataFrame([(n, " ".join(f"word{n % 3}x{k}" for k in range(40)) + " end" * (n // 3)) for n in range(6)], "doc_id long, text string")
    assert golay_dedup.keep_rows(docs).count() == 3
    assert asked
