"""Near copies of the pipeline against all pairs: edits of every kind, and keys with many members."""

from __future__ import annotations

import random

from test_golay_dedup import brute_similar
from wiretally.llm import golay_dedup


def grouped(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in golay_dedup.similar_groups(docs).collect()}


def test_no_contiguous_edit_is_missed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(160).collect()
    texts = [w for w in ((r.text or "").split() for r in docs) if len(w) >= 40]
    rows = []
    for n, words in enumerate(texts):
        size, other = len(words), texts[n - 1]
        more = (other * (size // len(other) + 1))[: size * 17 // 100]
        spaced = [other[i % len(other)] if i % 60 == 30 else w for i, w in enumerate(words)]
        edits = [words, words + more, more + words, words[: size * 83 // 100], words[: size // 3] + more[: size // 12] + words[size // 3 + size // 12 :], spaced]
        rows.append((6 * n, " ".join(words)))
        edit = edits[1 + n % 5]
        rows.append((6 * n + 1, " ".join(edit)))
    want = brute_similar(rows)
    assert sum(want[6 * n + 1] == want[6 * n] for n in range(len(texts))) > 0.8 * len(texts)
    assert grouped(spark, rows) == want


def test_no_link_inside_large_keys_is_missed(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(6000)]
    common, rows = rng.sample(words, 100), []
    for group in range(12):
        own = rng.sample(words, 25)
        for n in range(6):
            last = [*own, *rng.sample(words, 1 + n % 3)]
            rows.append((group * 100 + n, " ".join(common + last)))
    want = brute_similar(rows)
    chain = [rng.sample(words, 60)]
    for n in range(60):
        chain.append(chain[-1][2:] + rng.sample(words, 2))
    rows += [(5000 + n, " ".join(c)) for n, c in enumerate(chain)]
    want = brute_similar(rows)
    assert want[5060] == 5000
    assert grouped(spark, rows) == want


def test_whole_table_is_exact(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert grouped(spark, rows) == brute_similar(rows)
