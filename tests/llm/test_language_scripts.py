"""Languages that share a script outside Latin-1."""

from __future__ import annotations

import random
import zlib

from wiretally.llm import language_id

WORDS = {
    "ru": "что это был как она его только если время человек жизнь большой можно когда", "uk": "що це був як вона його тільки якщо час людина життя великий можна коли",
    "ar": "هذا التي كان على الذي بعد كتاب مدينة كبير الناس", "fa": "این است که برای کتاب شهر بزرگ مردم می‌شود چگونه",
    "pl": "że jest był się tylko człowiek życie duży można kiedy", "cs": "že je byl se jen člověk život velký může když",
}


def test_languages_of_one_script(spark):
    rng, rows = random.Random(5), []
    for lang, words in WORDS.items():
        rows += [(len(rows) + n, " ".join(rng.choices(words.split(), k=8)), lang) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {d: lang for d, _, lang in rows}
    held = [r for r in language_id.predict(docs).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 60 and all(r.lang_pred == want[r.doc_id] for r in held)


def test_letters_of_other_scripts_differ():
    for a, b in (("жизнь", "ةتبكم"), ("абв", "вба"), ("łąk", "řěk")):
        assert not set(language_id.triples(a)) & set(language_id.triples(b))
