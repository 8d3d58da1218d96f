"""Language identification against a plain loop over the same dictionaries, and awkward rows."""

from __future__ import annotations

import random
import zlib

import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from seqspark.llm import language_id as L

DOCS = "doc_id long, text string, lang string, source string, score double, i string, t string, lang_pred string"
SOUNDS = {"aa": "ka na ta wo mi re su".split(), "bb": "sch ung heit der ein ver".split(), "cc": "ción os ar que la en".split()}


def words(rnd, lang, n):
    return " ".join("".join(rnd.choices(SOUNDS[lang], k=rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = [(k, words(rnd, lang := rnd.choice("aa bb cc".split()), rnd.choice([3, 20, 90])), lang, None, None, "x", "y", "z") for k in range(240)]
    out += [(300, None, "aa", "s", 1.0, None, None, None), (301, "", "bb", None, None, None, None, None), (302, "12 -- 34!", "cc", None, None, None, None, None)]
    out += [(303, words(rnd, "bb", 40_000), None, None, None, None, None, None), (None, words(rnd, "aa", 30), "aa", None, None, None, None, None)]
    return [*out, out[0], *[out[1]] * 80]


def test_equals_a_plain_loop(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    known = L.learn(docs)
    assert {k for k, _ in known} == {"aa", "bb", "cc"} and all(0 < len(d) <= L.DICTIONARY for _, d in known)
    want = []
    for i, text, *_ in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        if text is None or not regex.search(r"\p{L}", text):
            want.append((i, held, "und", 0.0, True))
            continue
        raw = regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).encode()
        n = max(1, round(len(raw) / L.PIECE))
        step = max(1, -(-len(raw) // n))
        sizes = []
        for _, content in known:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[k : k + step])) for k in range(0, len(raw), step)))
        least, second = sorted(sizes)[:2]
        margin = (second - least) / second
        want.append((i, held, known[sizes.index(least)][0], margin / (margin + L.NARROW), margin < L.NARROW))
    got = [tuple(r) for r in L.classify(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_held_out_accuracy(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    true = {r[0]: r[2] for r in rows if r[1] and len(r[1]) > 60 and r[2] and r[0] is not None and r[0] < 240}
    out = [r for r in L.classify(docs).where("held_out").collect() if r.doc_id in true]
    assert len(out) > 20 and all(r.lang_pred == true[r.doc_id] for r in out)


def test_no_leak_from_held_out_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    assert L.learn(other) == L.learn(docs)


def test_nothing_learned_one_language_and_empty(spark, rows):
    docs = spark.createDataFrame(rows[:40], DOCS)
    out = L.classify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in out} == {("und", 0.0, True)}
    assert {r.lang_pred for r in L.classify(docs.withColumn("lang", F.lit("q"))).collect()} == {"q"}
    assert L.classify(spark.createDataFrame([], DOCS)).count() == 0


def test_too_many_languages_is_an_error(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        L.learn(spark.createDataFrame(rows, DOCS))


def test_ties_take_the_first():
    assert L.judged([5, 5, 9]) == (0, 0.0)
    assert L.judged([9, 5, 5])[0] == 1
    assert b"".join(L.pieces(b"x" * 5000)) == b"x" * 5000 and L.pieces(b"") == []
