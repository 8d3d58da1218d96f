"""Language identification by compression.

Each language has a dictionary of raw passages of its training texts. A text, lower-cased and with all but
letters and marks turned to single blanks, is cut into pieces that are encoded by zstandard with each
dictionary; the language with the fewest bytes over the whole text is its language. The closer the second,
the lower the score; a margin below NARROW rejects.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.llm import common
from seqspark.llm.toxicity import held_out

#: The sample that a language's dictionary is fitted on: at most so many passages of so many characters, cut to so many bytes.
PASSAGES, PASSAGE, DICTIONARY = 512, 256, 32 << 10
#: Languages that can be learned; each is a dictionary in every worker and an encoding of every text. More raise an error.
LANGUAGES = 1000
#: Bytes that are encoded at a time, so that a long text does not become its own dictionary.
PIECE = 1024
LEVEL = 6
#: The share by which the second language must be longer; at this margin the score is 0.5.
NARROW = 0.01
UNKNOWN = "und"


def plain(text):
    """Lower case, letters and marks only, single blanks between."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def learn(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) of training rows, the language of most rows first.

    Of each language the passages of the lowest hashes of distinct texts are taken, each from a place in its
    text that the hash chooses. Rows without language, letters or text are left out.
    """
    lang = docs[lang_column].cast("string")
    rows = docs.select(lang.alias("lang"), docs[text_column].alias("t")).where(F.col("lang").isNotNull() & ~held_out(docs[id_column]) & docs[text_column].rlike(r"\p{L}"))
    counts = sorted(rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect(), key=lambda r: (-r.n, r.lang))
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return []
    # texts whose hash is below this share of all hashes are looked at: about twice the passages wanted
    span = 1 << 40
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(span, span * 2 * PASSAGES // r.n))))
    h = F.xxhash64("t")
    some = rows.withColumn("h", h.bitwiseAND(F.lit(span - 1))).where(F.col("h") < share[F.col("lang")])
    clean = F.trim(plain(F.col("t")))
    begin = F.pmod(F.shiftright(F.xxhash64("t"), 13), F.greatest(F.lit(1), F.length("p") - PASSAGE)).cast("int") + 1
    some = some.select("lang", "h", "t", clean.alias("p")).select("lang", "h", F.substring(F.col("p"), begin, F.lit(PASSAGE)).alias("p")).distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "p"))
    taken = some.withColumn("rank", rank).where(F.col("rank") <= PASSAGES).select("lang", "rank", "p").toArrow().to_pylist()
    by: dict[str, list[str]] = {}
    for r in sorted(taken, key=lambda r: r["rank"]):
        by.setdefault(r["lang"], []).append(r["p"])
    return [(r.lang, " ".join(by.get(r.lang, [])).encode()[:DICTIONARY]) for r in counts]


def encoder(content: bytes) -> zstandard.ZstdCompressor:
    """Frames without length, checksum or dictionary id; content (of 8 bytes at least) stands before what is encoded."""
    settings = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) < 8:
        return zstandard.ZstdCompressor(**settings)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(dict_data=known, **settings)


def pieces(raw: bytes) -> list[bytes]:
    """raw in pieces of about PIECE bytes and like size."""
    n = max(1, round(len(raw) / PIECE))
    step = max(1, -(-len(raw) // n))
    return [raw[k : k + step] for k in range(0, len(raw), step)]


def judged(sizes: list[int]) -> tuple[int, float]:
    """The place of the smallest size (the first of equals), and 0.5 where the next is NARROW longer, more beyond."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    second = min(sizes[:best] + sizes[best + 1 :])
    margin = (second - sizes[best]) / max(1, second)
    return best, max(0.0, margin / (margin + NARROW))


def classify(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The language of every whole text: id_column, held_out, lang_pred, score (0 to 1), rejected.

    Dictionaries are learned from rows with a language that are not held out (crc32 of the id as text mod 4
    is 2 holds out); nothing but the text enters a prediction. lang_pred is the language of the smallest
    encoding, of equals the one with the most training rows; "und" for a null text, a text without letters,
    or if nothing was learned (score 0, rejected). rejected tells that the margin is narrow; lang_pred then
    still is the best guess. With one language learned the margin is to an encoding without dictionary.
    Null and repeated ids give a row each; an empty table gives an empty one; other columns are ignored.
    """
    common.small_batches(docs.sparkSession)
    known = learn(docs, id_column=id_column, text_column=text_column, lang_column=lang_column)
    told = [*known, (UNKNOWN, b"")] if len(known) == 1 else known
    rows = docs.select(docs[id_column].alias("i"), F.when(docs[text_column].rlike(r"\p{L}"), plain(docs[text_column])).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(content) for _, content in told]
        for whole in batches:
            for batch in common.slices(whole, "t"):
                found, score = [], []
                for text in batch.column("t").to_pylist():
                    if text is None or not known:
                        found.append(UNKNOWN), score.append(0.0)
                        continue
                    parts = pieces(text.encode())
                    best, s = judged([sum(len(e.compress(p)) for p in parts) for e in encoders])
                    found.append(told[best if len(known) > 1 else 0][0]), score.append(s)
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["i", "lang_pred", "score"])

    kind = T.StructType([rows.schema["i"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(common.tidy(run), kind)
    return out.select(F.col("i").alias(id_column), held_out(F.col("i")).alias("held_out"), "lang_pred", "score", (F.col("score") < 0.5).alias("rejected"))
