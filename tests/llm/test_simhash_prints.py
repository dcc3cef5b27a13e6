from __future__ import annotations

import hashlib
import random
import re
import struct

import xxhash

import __spark_entry__ as entry
from wiretally.llm import simhash_prints as s

SF = "/root/testdata/sf0.001"


def long_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
    return seed


def brute_print(text):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    terms = [long_hash(a, b) for a, b in zip(words, words[1:])] or [long_hash(w) for w in words]
    out = ""
    for half in (1, 0):
        values = [xxhash.xxh64_intdigest(struct.pack("<I", 1), long_hash(t)) for t in terms] if half else terms
        out += f"{sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values)):016x}"
    return out


def brute(rows):
    """Expected columns of rows (id, text) in the order of ids, next ones wrapping around."""
    order = sorted(rows, key=lambda r: -r[0])
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [brute_print(t) for t in (text, edited, after)]
        like = [1 - (int(prints[0], 16) ^ int(p, 16)).bit_count() / 128 for p in prints[1:]]
        yield doc, (len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], *like)


def of(rows):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows}


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = entry.queries()["op8_simhash_prints"](spark, SF)
    assert not any(word in got._jdf.queryExecution().toString() for word in ("Python", "Arrow", "Pandas"))
    rows = got.collect()
    assert len(rows) == len(docs) and of(rows) == dict(brute(docs))
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)


def test_odd_rows(spark):
    rows = [(-5, "one"), (0, ""), (1, "A b"), (7, "a b c é   d"), (8, "x y " * 70_000), (2**62, "z")]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fingerprint string, range int")
    assert of(s.with_edits(frame).collect()) == dict(brute(rows))
    assert s.with_edits(frame.limit(0)).collect() == []
    single = s.with_edits(frame.where("doc_id = 1")).collect()
    assert of(single) == dict(brute([(1, "A b")]))
    odd = spark.createDataFrame([(None, "tail"), (3, None), (3, None), (3, "b b"), (3, "b b")], "doc_id long, text string")
    got = s.with_edits(odd).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 4), (3, 0), (3, 0), (3, 3), (3, 3)]
    assert len({r.fingerprint for r in got if r.n_chars == 3}) == 1


def test_block_tables_find_all_within_radius(spark):
    rng, values = random.Random(4), set()
    for _ in range(40):
        centre = rng.getrandbits(128)
        for _ in range(6):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 4))))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    halves = {v: (signed(v >> 64), signed(v & (1 << 64) - 1)) for v in values}
    frame = spark.createDataFrame([*halves.values(), *list(halves.values())[:9]], "hi long, lo long")
    for radius in (0, 1, 3, 6):
        got = {tuple(r) for r in s.near_pairs(frame, radius).collect()}
        want = set()
        for a in values:
            for b in values:
                gap = (a ^ b).bit_count()
                if gap <= radius and halves[a] < halves[b]:
                    want.add((*halves[a], *halves[b], gap))
        assert got == want
