from __future__ import annotations

import random

import numpy as np
import xxhash

import __spark_entry__ as entry
from wiretally.llm import golay_dedup
from wiretally.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(ids)):
        gap = np.bitwise_count(values[i + 1 :] ^ values[i])
        for j in np.nonzero(gap <= 2)[0]:
            root[find(i + 1 + int(j))] = find(i)
    least = {}
    for i, doc in enumerate(ids):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [least[find(i)] for i in range(len(ids))]


def brute_similar(rows):
    """id -> least id of its group, over all pairs of texts."""
    sets = {d: golay_dedup.shingle_set(t or "") for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def test_decoding_reaches_every_word():
    words = np.random.default_rng(1).integers(0, 1 << 23, 20_000).astype(np.uint32)
    index = golay_dedup.codeword_index(words)
    unit, errors = golay_dedup._code()
    assert len(np.unique(errors)) == 2048
    syndrome = np.zeros(len(words), np.uint32)
    for bit in range(23):
        syndrome ^= (words >> np.uint32(bit) & np.uint32(1)) * unit[bit]
    assert (np.bitwise_count(errors[syndrome]) <= 3).all()
    assert (index < 4096).all()


def test_pairs_within_two_bits_share_a_key():
    rng = random.Random(2)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        _, keys = golay_dedup.fuzzy_keys(np.array([a], np.uint64))
        _, others = golay_dedup.fuzzy_keys(np.array([b], np.uint64))
        assert set(keys.tolist()) & set(others.tolist())
        assert len(keys) == len(set(keys.tolist()))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [brute_print(r.text) for r in docs]
    want = dict(zip([r.doc_id for r in docs], zip(prints, brute_components([r.doc_id for r in docs], prints))))
    got = entry.queries()["op9_golay_dedup"](spark, sf).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == want and len(got) == len(docs)


def test_links_of_small_and_large_keys(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(80):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "print long")
    want = brute_components(signed, values)
    for paired in (0, 3, 64):
        roots = {r.node: r.root for r in components(golay_dedup.links(frame, paired)).collect()}
        assert [roots.get(v, v) for v in signed] == want


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (9, " \t\n", 3), (1, "A b", 4), (2, "a  B\x0b", 5), (7, "é É", 6), (7, "x " * 50_000, 7), (None, "a b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = golay_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, int(r.fingerprint, 16)) for r in got) == sorted((d or 0, brute_print(t)) for d, t, _ in rows)
    named = {(r.doc_id, r.component_id) for r in got}
    assert {(5, 3), (3, 3), (9, 3), (1, 1), (2, 1), (None, 1)} <= named
    assert golay_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_similar_groups_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in golay_dedup.similar_groups(docs).collect()}
    want = brute_similar([(r.doc_id, r.text) for r in docs.collect()])
    assert len(set(want.values())) < len(want) and got.keys() == want.keys()
    assert sum(got[d] != want[d] for d in want) <= 0.01 * len(want)


def test_large_keys_of_near_copies(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(4000)]
    base = rng.sample(words, 200)
    rows = []
    for n in range(150):
        own = list(base)
        own[rng.randrange(200)] = rng.choice(words)
        rows.append((n, " ".join(own)))
    rows += [(200 + n, " ".join(base[::-1])) for n in range(60)] + [(300 + n, " ".join(rng.sample(words, 100))) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in golay_dedup.similar_groups(docs).collect()}
    want = brute_similar(rows)
    assert sum(got[d] != want[d] for d in want) <= 2 and got[200] == got[259] == 200 and got[310] == 310


def test_keep_one(spark):
    rows = [(5, None, 1), (3, "", 2), (1, "A b", 4), (2, "a  B\x0b", 5), (7, "é É", 6), (7, "x " * 50_000, 7), (None, "a b", 8), (None, "q", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    kept = golay_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b"), (1, "A b"), (3, ""), (7, "x " * 50_000)]
    assert golay_dedup.keep_one(docs.limit(0)).collect() == []
