"""Text quality by an interpolated modified Kneser-Ney model of character n-grams.

The model is counted on trusted texts. Counts, continuation counts, discounts and back-off weights are
DataFrames sharded by n-gram, and joined by prefix and suffix. The n-grams that occur anywhere in the corpus
are resolved against them by the same joins; a document's perplexity is the mean over its n-grams. A
document is kept if its perplexity is within its language's quantile of trusted texts held out.

An n-gram is a long of 12 bits a character, the last in the lowest bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.llm import common, pretok
from seqspark.llm.common import Scratch
from seqspark.llm.toxicity import held_out

ORDER, BITS = 5, 12
#: Characters from here on share 512 classes; class 0 stands before a text.
DIRECT = 3584
#: Resolved n-grams that are sent to all workers at a time (12 bytes each); more are sent in slices, one pass over the documents each.
BROADCAST_GRAMS = 2_000_000
#: Slices at most; beyond, documents are joined to the n-grams, which moves several times the input.
MOST_SLICES = 16
#: A prime that deals n-grams into slices by all of their characters.
DEALT = 1009
#: Trusted ids that are sent to all workers (16 bytes each); beyond, texts are joined to them.
BROADCAST_IDS = 500_000
#: A text's mean is drawn to its language's by this many characters.
PRIOR_CHARS = 100
#: The quantile of a language's excess over its mean is drawn to that of all languages by this many texts.
PRIOR_TEXTS = 30


def gram_codes(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, and where each text begins."""
    cp, at = pretok.code_points(texts)
    x = cp.astype(np.int64)
    x = np.where(x < DIRECT, x, DIRECT + x % 512)
    x[x == 0] = 1
    code = x.copy()
    place = np.arange(len(x)) - np.repeat(at[:-1], np.diff(at))  # within the text
    for k in range(1, order):
        before = np.zeros(len(x), np.int64)
        before[k:] = x[:-k]
        before[place < k] = 0
        code |= before << (BITS * k)
    return code, at


def counted(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n): all n-grams of texts(t, w) and how often they are in rows with w, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0)
        for whole in batches:
            for batch in common.slices(whole, "t", 1 << 19):
                code, at = gram_codes([x or "" for x in batch.column("t").to_pylist()], order)
                weight = np.repeat(np.array(batch.column("w").to_pylist(), bool), np.diff(at))
                new, good = np.unique(code), code[weight]
                some, n = np.unique(good, return_counts=True)
                keys, back = np.unique(np.concatenate([keys, new, some]), return_inverse=True)
                sums = np.bincount(back, np.concatenate([sums, np.zeros(len(new)), n]), len(keys))
                if len(keys) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums.astype(np.int64))], ["gram", "n"])
                    keys, sums = keys[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums.astype(np.int64))], ["gram", "n"])

    return texts.mapInArrow(common.tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def suffix(gram, order: int):
    """The last `order` characters."""
    return gram.bitwiseAND(F.lit((1 << BITS * order) - 1))


def prefix(gram):
    return F.shiftrightunsigned(gram, BITS)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and 3 or more from the counts of counts."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(v, 0.05), i) for i, v in enumerate(found, 1))  # type: ignore[return-value]


def train(counts: DataFrame, scratch: Scratch, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """The model from counts (gram, n) of the highest order: (k, gram, own) and (k, context, rest).

    own is the discounted share of an n-gram of order k in its context, rest the weight with which a context
    passes on to the next shorter one. Orders below the highest use continuation counts (how many characters
    come before); discounts are estimated per order.
    """
    longer = counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), suffix(F.col("gram"), k + 1).alias("g")) for k in range(1, order)))).alias("x")).select("x.*").distinct()
    lower = longer.groupBy("k", F.expr(f"g & ((1L << {BITS} * k) - 1)").alias("gram")).agg(F.count("*").alias("n"))
    levels = scratch.save(lower.union(counts.select(F.lit(order), "gram", "n")), "levels")
    found = {r.k: discounts(*(r[1:])) for r in levels.groupBy("k").agg(*(F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4))).collect()}
    d = F.lit(0.0)
    for k, (one, two, more) in found.items():
        d = F.when(F.col("k") == k, F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)).otherwise(d)
    rows = levels.withColumn("context", prefix(F.col("gram"))).withColumn("d", d)
    contexts = scratch.save(rows.groupBy("k", "context").agg((F.sum("d") / F.sum("n")).alias("rest"), F.sum("n").alias("total")), "contexts")
    own = rows.join(contexts, ["k", "context"]).select("k", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"))
    return scratch.save(own, "own"), contexts.select("k", "context", "rest")


def resolve(grams: DataFrame, own: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, cost): minus the log of the interpolated probability of each n-gram.

    An n-gram that was not counted has no share of its own, and a context that was not passes on all.
    """
    p, out = F.lit(1.0 / (DIRECT + 512)), grams.select("gram")
    for k in range(1, order + 1):
        share = own.where(F.col("k") == k).select(F.col("gram").alias(f"g{k}"), F.col("own").alias(f"own{k}"))
        passed = contexts.where(F.col("k") == k).select(F.col("context").alias(f"c{k}"), F.col("rest").alias(f"rest{k}"))
        part = suffix(F.col("gram"), k)
        out = out.join(share, part == F.col(f"g{k}"), "left").join(passed, prefix(part) == F.col(f"c{k}"), "left")
        out = out.select("gram", (F.coalesce(f"own{k}", F.lit(0.0)) + F.coalesce(f"rest{k}", F.lit(1.0)) * p).alias("p"))
        p = F.col("p")
    return out.select("gram", (-F.log("p")).cast("float").alias("cost"))


class Costs:
    """Costs of one of `slices` parts of the n-grams in every worker: one broadcast of sorted arrays, 12 bytes an n-gram and nothing built from them."""

    def __init__(self, costs: DataFrame, part: int = 0, slices: int = 1):
        own = costs.where(F.floor(F.col("gram") % DEALT * slices / DEALT) == part) if slices > 1 else costs
        rows = own.select("gram", "cost").toArrow()
        grams, values = rows["gram"].to_numpy(), rows["cost"].to_numpy()
        order = np.argsort(grams)
        self.part, self.slices = part, slices
        self.told = costs.sparkSession.sparkContext.broadcast((grams[order], values[order]))
        del own, rows, grams, values, order
        common.release()

    @staticmethod
    def find(told: tuple[np.ndarray, np.ndarray], codes: np.ndarray, part: int = 0, slices: int = 1) -> np.ndarray:
        """Costs of codes, 0 for those of other slices; each distinct one is searched once, in ascending order."""
        keys, values = told
        some, back = np.unique(codes, return_inverse=True)
        here = some % DEALT * slices // DEALT == part
        own = some[here]
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        if len(own) and (not len(keys) or (keys[at] != own).any()):
            raise KeyError("an n-gram without a cost")
        found = np.zeros(len(some), np.float32)
        found[here] = values[at] if len(own) else 0
        return found[back]


def told_costs(costs: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> list[Costs] | None:
    """The costs for all workers in slices, or None where they are too many and documents have to be joined to them."""
    slices = max(1, -(-costs.count() // broadcast_grams)) if broadcast_grams else MOST_SLICES + 1
    return [Costs(costs, k, slices) for k in range(slices)] if slices <= MOST_SLICES else None


def _adder(costs: Costs, field: str | None, names: list[str]):
    """A function of batches (i, lang, t, chars, cost) that adds the costs of one slice and sets chars."""
    table, part, slices = costs.told, costs.part, costs.slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "i" if field else "t", 1 << 19):
                texts = batch.column("i").field(field) if field else batch.column("t")
                code, at = gram_codes([x or "" for x in texts.to_pylist()])
                upto = np.zeros(len(code) + 1)
                np.cumsum(Costs.find(table.value, code, part, slices), out=upto[1:], dtype=np.float64)
                new = {"chars": pa.array(np.diff(at)), "cost": pa.array(batch.column("cost").to_numpy() + (upto[at[1:]] - upto[at[:-1]]))}
                yield pa.RecordBatch.from_arrays([new[x] if x in new else batch.column(x) for x in names], names)

    return run


def document_costs(docs: DataFrame, costs: DataFrame, known: list[Costs] | None, field: str | None = None) -> DataFrame:
    """docs(i, lang, t) -> (i, lang, chars, cost): characters and summed cost of each row.

    i may be of any type, also a struct that holds the text as `field` (then there is no t). known: told_costs(costs). With
    several slices the rows are written between two passes, each of which adds to the sums; nothing is shuffled.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    if known is not None:
        text, scratch = [] if field else ["t"], Scratch(spark)
        rows = docs.select("i", "lang", *text, F.lit(0).cast("long").alias("chars"), F.lit(0.0).alias("cost"))
        for k, one in enumerate(known):
            last = k == len(known) - 1
            more = T.StructType([x for x in rows.schema if not (last and x.name == "t")])
            step = rows.mapInArrow(common.tidy(_adder(one, field, more.names)), more)
            if last:
                return step.select("i", "lang", "chars", "cost")
            saved = scratch.save(step, "costed")
            if k:
                scratch.drop(rows)
            rows = saved

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "t", 1 << 19):
                code, at = gram_codes([x or "" for x in batch.column("t").to_pylist()])
                row = np.repeat(np.arange(batch.num_rows), np.diff(at))
                order = np.lexsort((code, row))
                code, row = code[order], row[order]
                first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(code) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(code)))
                keys = batch.column("r").take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(code[first]), pa.array(n)], ["r", "gram", "n"])

    text = F.col("i").getField(field) if field else F.col("t")
    named = Scratch(spark).save(docs.select("i", "lang", text.alias("t"), F.monotonically_increasing_id().alias("r")), "rows")
    grams = named.select("r", "t").mapInArrow(common.tidy(spread), "r long, gram long, n long").join(costs, "gram")
    sums = grams.groupBy("r").agg(F.sum("n").alias("chars"), F.sum(F.col("n") * F.col("cost").cast("double")).alias("cost"))
    out = named.select("r", "i", "lang").join(sums, "r", "left")
    return out.select("i", "lang", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


@dataclass
class Judge:
    """n-gram costs, means and limits of languages, and what holds for a language without held-out trusted texts."""

    costs: DataFrame
    by_lang: DataFrame
    all_mean: float
    all_limit: float | None
    slack: float
    known: list[Costs] | None

    def kept(self, each: DataFrame) -> DataFrame:
        """each(i, lang, chars, cost) -> (i, chars, perplexity, threshold, kept)."""
        d = each.join(F.broadcast(self.by_lang), F.col("lang").eqNullSafe(F.col("l")), "left")
        perplexity = F.exp((F.col("cost") + PRIOR_CHARS * F.coalesce("lang_mean", F.lit(self.all_mean))) / (F.col("chars") + PRIOR_CHARS))
        d = d.select("i", "chars", perplexity.alias("perplexity"), (self.slack * F.exp(F.coalesce("lang_limit", F.lit(self.all_limit).cast("double")))).alias("threshold"))
        return d.withColumn("kept", F.coalesce((F.col("perplexity") <= F.col("threshold")) | (F.col("chars") == 0), F.lit(True)))


def judge(docs: DataFrame, trusted: DataFrame, *, quantile: float, slack: float, id_column: str, text_column: str, lang_column: str, broadcast_grams: int) -> tuple[Judge, DataFrame]:
    """Fit on trusted texts; also the rows (i, t, lang)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    common.small_batches(spark)
    known = trusted.select(F.col(id_column).alias("k")).where("k is not null").distinct()
    few = known.count() <= BROADCAST_IDS
    told = lambda d: F.broadcast(d) if few else d
    rows = docs.select(docs[id_column].alias("i"), docs[text_column].alias("t"), docs[lang_column].cast("string").alias("lang"))
    fit = known.where(~held_out(F.col("k")))
    flagged = rows.select("i", "t").join(told(fit), F.col("i") == F.col("k"), "left").select("t", F.col("k").isNotNull().alias("w"))
    grams = scratch.save(counted(flagged), "grams")
    costs = scratch.save(resolve(grams, *train(grams.where("n > 0"), scratch)), "costs")
    held = rows.join(told(known.where(held_out(F.col("k")))), F.col("i") == F.col("k"), "left_semi")
    told_grams = told_costs(costs, broadcast_grams)
    held = scratch.save(document_costs(held, costs, told_grams).where("chars > 0"), "held", few=True)
    mean = F.sum("cost") / F.sum("chars")
    all_mean = held.agg(mean.alias("m")).first()["m"] or 0.0
    lang_mean = (F.sum("cost") + PRIOR_CHARS * F.lit(all_mean)) / (F.sum("chars") + PRIOR_CHARS)
    by_lang = held.groupBy(F.col("lang").alias("l")).agg(lang_mean.alias("lang_mean"), F.count("*").alias("lang_n"))
    over = held.join(F.broadcast(by_lang), F.col("lang").eqNullSafe(F.col("l"))).select("l", "lang_mean", "lang_n", ((F.col("cost") - F.col("chars") * F.col("lang_mean")) / (F.col("chars") + PRIOR_CHARS)).alias("over"))
    high = F.percentile_approx("over", quantile, 10_000)
    all_over = over.agg(high.alias("m")).first()["m"]
    all_limit = None if all_over is None else all_mean + all_over
    drawn = F.col("lang_mean") + (F.col("lang_n") * F.col("high") + PRIOR_TEXTS * F.lit(all_over).cast("double")) / (F.col("lang_n") + PRIOR_TEXTS)
    by_lang = scratch.save(over.groupBy("l", "lang_mean", "lang_n").agg(high.alias("high")).select("l", "lang_mean", drawn.alias("lang_limit")), "langs")
    return Judge(costs, by_lang, all_mean, all_limit, slack, told_grams), rows


def classify(docs: DataFrame, trusted: DataFrame, *, quantile: float = 0.99, slack: float = 1.1, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Perplexity of every whole text and whether it is kept.

    trusted: ids of trusted texts. A quarter of them (crc32 of the id as text mod 4 is 2) is held out of the
    counts and sets the thresholds: slack times the quantile of the perplexity of each language. The quantile's
    distance from the language's mean is drawn to that of all languages, the less the more held-out texts there
    are; a language without any has the mean and quantile of all. Returns id_column, chars, perplexity (per character, drawn to the mean of
    the language for short texts), threshold and kept. A null language is one of its own; null and empty
    texts have no n-grams, the mean perplexity, and are kept; without trusted texts everything is kept.
    Null and repeated ids give a row each; an empty table gives an empty one; other columns are ignored.
    """
    found, rows = judge(docs, trusted, quantile=quantile, slack=slack, id_column=id_column, text_column=text_column, lang_column=lang_column, broadcast_grams=broadcast_grams)
    return found.kept(document_costs(rows, found.costs, found.known)).withColumnRenamed("i", id_column)


def keep_good(docs: DataFrame, trusted: DataFrame, *, quantile: float = 0.99, slack: float = 1.1, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns."""
    found, _ = judge(docs, trusted, quantile=quantile, slack=slack, id_column=id_column, text_column=text_column, lang_column=lang_column, broadcast_grams=broadcast_grams)
    rows = docs.select(F.struct(*docs.columns).alias("i"), docs[lang_column].cast("string").alias("lang"))
    return found.kept(document_costs(rows, found.costs, found.known, text_column)).where("kept").select("i.*")
