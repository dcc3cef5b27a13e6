from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from wiretally.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, docs, window=1024):
    """Every id in exactly one piece, sequences gapless and in order; returns the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert sum(len(v) for v in docs.values()) == sum(len({p.start: 0 for p in pieces[d] if p.start == 0}) for d in pieces)
    for doc, (text,) in docs.items():
        ids, at = ids_of(text), 0
        for p in sorted(pieces[doc], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            part = np.asarray(ids[at : at + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(part)
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / total


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text,) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(entry.queries()["op1_packing"](spark, sf).collect(), docs) < 0.03


def test_odd_rows(spark):
    texts = [None, "", " ", "  a  b", "a \n b\n\n c", "x   y", "tab\t end ", "<|endoftext|> and <|endoftext|>", "é" * 5000, "word " * 4000, "a.b! c? d\n" * 900]
    rows = [(n, t, "clash") for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    check(packing.pack(df).collect(), {n: (t,) for n, t, _ in rows})
    assert packing.pack(df.limit(0)).collect() == []
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")).collect()
    lengths = defaultdict(int)
    for r in twice:
        lengths[r.doc_id] += r.length
    assert lengths == {None: 2, 1: 6}


def test_short_runs_carry_over(spark):
    df = spark.createDataFrame([(n, "one two three. " * (n % 7)) for n in range(300)], "doc_id long, text string")
    docs = {r.doc_id: (r.text,) for r in df.collect()}
    assert check(packing.pack(df.coalesce(1), run_tokens=1500).collect(), docs) < 0.2


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    at, window = [0], 32
    for _ in range(60):
        at.append(at[-1] + rng.randint(1, 12))
    penalty = [rng.choice([0, 4, 32]) for _ in at]

    def cost(i, j):
        length = at[j] - at[i]
        free = length in (8, 16, 32)
        return (0 if free else window - length) + penalty[j] + packing.PER_SEQUENCE

    best = [0.0]
    for j in range(1, len(at)):
        best.append(min(best[i] + cost(i, j) for i in range(j) if at[j] - at[i] <= window))
    cuts = packing.choose_cuts(at, penalty, window, least_power=8)
    assert cuts[-1] == len(at) - 1
    assert sum(cost(i, j) for i, j in zip([0, *cuts], cuts)) == best[-1]
