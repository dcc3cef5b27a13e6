from __future__ import annotations

import zlib

import __spark_entry__ as entry
from wiretally.llm import language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op10_language_id"](spark, SF).collect()
    assert len(got) == len(langs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    rows = [(n, f"der die das und nicht {n} schule haus", "de", "x") for n in range(30)]
    rows += [(n + 100, f"the house is not and {n} with school", "en", "x") for n in range(30)]
    rows += [(500, None, "de", "x"), (501, "", "en", "x"), (502, "123 !?", None, "x"), (None, "the house", None, "x"), (503, "the house " * 50_000, None, "x"), (504, "дом и мир", None, "x"), (505, "𝐭", None, "x"), (503, "und das haus", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.predict(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.lang_pred): r for r in got}
    for doc in (500, 501, 502):
        assert by[doc, "und"].score == 0 and by[doc, "und"].rejected
    assert (None, "en") in by and not by[None, "en"].held_out
    assert (503, "en") in by and (503, "de") in by
    assert any(r.doc_id == 504 and r.rejected and r.lang_pred in ("de", "en") for r in got)
    assert any(r.doc_id == 505 and r.lang_pred != "und" for r in got)
    assert language_id.predict(docs.limit(0)).collect() == []
