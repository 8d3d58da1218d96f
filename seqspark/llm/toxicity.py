"""Toxicity scores of texts whose words may be disguised.

A noisy channel writes letters as look-alike symbols, spaces or dots words out, and repeats letters. Tokens
that may have gone through it are decoded by Viterbi search over a lattice of their characters under a
character trigram model counted on all texts. Words of letters alone are their own best path. The restored
words, and their beginnings, are scored by how toxic the labelled texts with them are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.llm import common, jaccard, pretok
from seqspark.llm.common import Scratch

#: Labelled rows that the scores are fitted on at most, by a hash of their id.
TRAIN_ROWS = 20_000
#: Words and beginnings of words kept at most, the surest first.
FEATURES = 20_000
#: Share of toxic texts among those with a feature that makes it evidence.
LEAST_PRECISION = 0.5
PREFIXES = (4, 5, 6, 8)
#: Length up to which what a token was decoded to is kept for the next one.
REMEMBERED = 80

# The letters of the character model, class 0 being the end of a word and the last any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
CLASSES = 64
# What symbols may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
SEPARATORS = " ._-*~'`^/\\,"
# Costs of the channel in nats: a look-alike, a dropped separator, a separator as the end of a word, a repeated
# letter written once or twice, a dropped symbol.
LOOK_COST, DROP_COST, BREAK_COST, ONCE_COST, TWICE_COST, LOSE_COST = 1.0, 0.7, 3.0, 0.3, 0.7, 6.0

EDGE = "\"'.,;:?!()[]{}<>«»“”…%#&*=/\\-_~^`"
TRIPLE = re.compile(r"(.)\1\1")
SPACED = re.compile(r"(?<![^\W_])(?<![^\W_]['’])(?:[^\W_]|[@$!|+€£])(?:(?:\s+|[._*-])(?:[^\W_]|[@$!|+€£])){2,}(?![^\W_])")
NUMBER = re.compile(r"[$€£+]?[\d.,_*~'`^/\\ -]+[$€£+]?")
LAST_RUN = re.compile(r"^(\W)\1\1+|(\W)\2\2+$")


def class_of_letters() -> np.ndarray:
    """Class of each code point as a letter; 0 where it is none."""
    out = np.where(pretok.class_table() == pretok.LETTER, CLASSES - 1, 0).astype(np.int64)
    for k, c in enumerate(LETTERS):
        out[ord(c)] = k + 1
    for k, c in enumerate(LETTERS):
        if len(c.upper()) == 1:
            out[ord(c.upper())] = k + 1
    return out


def trigram_counts(texts: list[str], classes: np.ndarray) -> np.ndarray:
    """Counts of letter class trigrams, [64 * 64 * 64]; each word begins and ends with class 0."""
    cp, _ = pretok.code_points(["\n".join(["", *texts, ""])])
    x = classes[cp]
    # two ends in a row only once: the context of a word's first letter is (0, 0)
    keep = (x > 0) | np.append(True, x[:-1] > 0)
    x = x[keep]
    before = np.append(0, x[:-1])
    # before a word's second letter comes its first, and before its first the end twice
    earlier = np.where(before == 0, 0, np.append([0, 0], x[:-2])[: len(x)])
    return np.bincount((earlier * CLASSES + before) * CLASSES + x, minlength=CLASSES**3)


class CharModel:
    """Interpolated trigram model over letter classes from counts[64 * 64 * 64]."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + CLASSES)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).reshape(CLASSES * CLASSES, CLASSES).tolist()
        self.number = {c: k + 1 for k, c in enumerate(LETTERS)}
        self.memory: dict[str, str] = {}

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """What each run of one character may have been written for, with costs; "" drops it, " " ends a word."""
        out = []
        for m in re.finditer(r"(.)\1*", token, re.S):
            c, n = m[1], len(m[0])
            if c.isalpha():
                ways = [(c, 0.0)] if n == 1 else [(c, ONCE_COST), (c * 2, TWICE_COST if n > 2 else 0.0)]
            else:
                ways = [(x, LOOK_COST) for x in LOOKS.get(c, "")]
                if n > 1:
                    ways += [(x * 2, LOOK_COST + TWICE_COST) for x in LOOKS.get(c, "")]
                ways += [("", DROP_COST), (" ", BREAK_COST)] if c in SEPARATORS else [("", LOSE_COST), (" ", LOSE_COST)]
            out.append(ways)
        return out

    def decode(self, token: str) -> str:
        """The likeliest letters behind a token (Viterbi over contexts of two classes)."""
        found = self.memory.get(token)
        if found is not None:
            return found
        number, cost = self.number, self.cost
        # what was read is a chain of (before, letters), so that long tokens are not copied at each step
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for ways in self.lattice(token):
            new: dict[int, tuple[float, tuple | None]] = {}
            for context, (spent, chain) in states.items():
                for letters, price in ways:
                    at, total = context, spent + price
                    for c in letters:
                        k = 0 if c == " " else number.get(c, CLASSES - 1)
                        if not k and not at % CLASSES:
                            continue  # already between words
                        total += cost[at][k]
                        at = (at % CLASSES) * CLASSES + k if k else 0
                    if at not in new or total < new[at][0]:
                        new[at] = total, (chain, letters)
            states = new
        chain, parts = min(((spent + (cost[at][0] if at else 0), at, chain) for at, (spent, chain) in states.items()), key=lambda x: x[:2])[2], []
        while chain:
            chain, letters = chain
            parts.append(letters)
        best = "".join(reversed(parts))
        if len(token) <= REMEMBERED:
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[token] = best
        return best


def doubtful(token: str) -> bool:
    """Whether a stripped token may be disguised: letters, look-alikes or separators, but not a number, price or address."""
    return len(token) >= 2 and all(c.isalpha() or c in LOOKS or c in SEPARATORS for c in token) and not NUMBER.fullmatch(token) and not ("@" in token and "." in token)


def restored_words(text: str, model: CharModel) -> set[str]:
    """Distinct words of a text, disguised ones restored."""
    low = text.lower()
    words = set()
    for token in set(low.split()):
        if not token.isalpha():
            bare = token.strip(EDGE)
            if not bare.isalpha():
                bare = LAST_RUN.sub("", bare).strip(EDGE)
            if not bare.isalpha():
                words.update(re.findall(r"[^\W\d_]+", bare))
                if doubtful(bare) or doubtful(bare := bare.rstrip("$!|+")):
                    words.update(model.decode(bare).split())
                continue
            token = bare
        words.add(token)
        if TRIPLE.search(token):
            words.update(model.decode(token).split())
    for m in SPACED.finditer(low):
        words.update(model.decode(" ".join(m[0].split())).split())
    return words


def features(words: set[str]) -> dict[str, set[str]]:
    """Evidence of each word: the word itself (led by a blank) and its beginnings."""
    return {w: {" " + w, *(w[:k] for k in PREFIXES if len(w) >= k)} for w in words}


@dataclass
class Model:
    """Character counts, the log odds ratio of each kept feature, and the logistic curve over their sum."""

    counts: np.ndarray
    weight: dict[str, float]
    offset: float = -6.0
    slope: float = 1.0

    def evidence(self, words: set[str]) -> float:
        """Sum over words of the weight of the word's strongest feature."""
        total, get = 0.0, self.weight.get
        for w in words:
            p = get(" " + w, 0.0)
            for k in PREFIXES:
                if len(w) < k:
                    break
                p = max(p, get(w[:k], 0.0))
            total += p
        return total

    def score(self, words: set[str]) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.offset + self.slope * self.evidence(words)))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope of the logistic curve over one weighted variable, by Newton's method with a light prior."""
    a, b, prior = -2.0, 0.5, np.array([0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        w = weight * p * (1 - p)
        g = np.array([(weight * (p - y)).sum(), (weight * (p - y) * x).sum()]) + prior * np.array([a, b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + np.diag(prior)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), max(float(b), 0.0)


def count_letters(texts: DataFrame) -> np.ndarray:
    """Letter trigram counts over all rows of texts(t): at most 64^3 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = class_of_letters(), np.zeros(CLASSES**3, np.int64)
        for whole in batches:
            for batch in common.slices(whole, "t", 1 << 20):
                total += trigram_counts([x for x in batch.column("t").to_pylist() if x], classes)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["k", "n"])

    rows = texts.mapInArrow(common.tidy(run), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CLASSES**3, np.int64)
    out[rows.k.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out


def least_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, y) with key, of the two least hashes of the text's three-word shingles; -1 for texts without words."""
    for batch in batches:
        acc, at = jaccard.shingles([x.encode("utf-8", "surrogatepass") if x else b"" for x in batch.column("t").to_pylist()], 3)
        key = [int(jaccard.mix(acc[a : a + 1] + jaccard.mix(acc[min(a + 1, b - 1) :][:1]))[0].astype(np.int64)) if b > a else -1 for a, b in zip(at.tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("y"), pa.array(key, pa.int64())], ["t", "y", "key"])


def tail(k: int, n: int, base: float) -> float:
    """Log of a bound on the chance of at least k of n at rate base (Chernoff)."""
    r = k / n
    if r <= base:
        return 0.0
    return -n * ((r * math.log(r / base)) + ((1 - r) * math.log((1 - r) / (1 - base)) if r < 1 else 0.0))


def fit(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Count letters on all texts and fit feature shares on labelled rows outside the held-out quarter.

    Rows whose crc32(id as text) mod 4 is 2 are never learned from. At most train_rows labelled rows are
    used, those of the lowest hash of their id; copies and near copies share the weight of one. A quarter of them sets the curve, the others
    the features. A feature is kept if its share of toxic texts is at least
    LEAST_PRECISION and too high for chance given how many features there are. Labels of one id that differ
    count as the higher; null labels and ids are left out. Without toxic labels no feature is kept.
    """
    common.small_batches(docs.sparkSession)
    counts = count_letters(docs.select(docs[text_column].alias("t")))
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(id_column).agg(F.max(label_column).cast("int").alias("y"))
    known = known.where(held_out(F.col(id_column)) == F.lit(False)).orderBy(F.xxhash64(id_column), id_column).limit(train_rows)
    scratch = Scratch(docs.sparkSession)
    train = docs.select(docs[id_column].alias(id_column), docs[text_column].alias("t")).join(F.broadcast(known), id_column).select("t", "y")
    # copies and near copies are one piece of evidence: those with the same least shingles share a weight of 1
    train = scratch.save(train.mapInArrow(common.tidy(least_shingle), "t string, y int, key long"), "keyed")
    train = train.join(F.broadcast(train.groupBy("key").agg((1 / F.count("*")).alias("weight"))), "key")
    train = train.select("t", "y", "weight", (F.pmod(F.hash("key"), F.lit(4)) == 0).alias("check"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CharModel(counts)
        for batch in batches:
            seen, toxic = Counter(), Counter()
            for text, y, weight in zip(*(batch.column(c).to_pylist() for c in ("t", "y", "weight"))):
                found = set().union(*features(restored_words(text or "", model)).values())
                found.add("")  # counts the texts
                for x in found:
                    seen[x] += weight
                    if y:
                        toxic[x] += weight
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([float(toxic[x]) for x in seen], pa.float64()), pa.array(list(seen.values()), pa.float64())], ["w", "k", "n"])

    found = train.where("not check").select("t", "y", "weight").mapInArrow(common.tidy(run), "w string, k double, n double").groupBy("w").agg(F.round(F.sum("k"), 6).alias("k"), F.round(F.sum("n"), 6).alias("n"))
    found = scratch.save(found, "words")
    size = found.agg(F.count(F.when(F.col("n") >= 3, 1)).alias("m"), F.max(F.when(F.col("w") == "", F.struct("k", "n"))).alias("all")).first()
    if not size["all"] or not size["all"]["k"]:
        return Model(counts, {})
    toxic, texts = size["all"]["k"], size["all"]["n"]
    base = min(0.99, max(toxic / texts, 1e-6))
    likely = found.where((F.col("w") != "") & (F.col("k") >= 2) & (F.col("k") >= LEAST_PRECISION * F.col("n"))).orderBy(F.desc("k"), "n", "w").limit(FEATURES).collect()
    limit = -math.log(2 * max(2, size["m"]))
    odds = lambda p: math.log(p / (1 - p))
    model = Model(counts, {r.w: odds((r.k + base) / (r.n + 1)) - odds(base) for r in likely if tail(r.k, r.n, base) <= limit})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = CharModel(counts)
        for batch in batches:
            x = [model.evidence(restored_words(t or "", letters)) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("y"), batch.column("weight")], ["x", "y", "w"])

    # the curve is fitted on rows whose words were not counted, so words that misled there cost it
    pairs = train.where("check").select("t", "y", "weight").mapInArrow(common.tidy(weigh), "x double, y int, w double").groupBy(F.round("x", 4).alias("x"), "y").agg(F.round(F.sum("w"), 6).alias("w")).toPandas()
    pairs = pairs.sort_values(["x", "y"])
    model.offset, model.slope = logistic(pairs.x.to_numpy(), pairs.y.to_numpy(np.float64), pairs.w.to_numpy(np.float64))
    return model


def held_out(doc_id):
    """crc32 of the id as text, mod 4, is 2; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """Score every whole text: id_column, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Nothing but the text enters a score. A null or empty text has the lowest score. A null id stays null and
    is not held out; repeated rows each give a row; an empty table gives an empty one; other columns are
    ignored.
    """
    model = fit(docs, labels, id_column=id_column, text_column=text_column, label_column=label_column)
    got = score_rows(docs.select(docs[id_column].alias("i"), docs[text_column].alias("t")), model)
    return got.select(F.col("i").alias(id_column), held_out(F.col("i")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_rows(rows: DataFrame, model: Model, field: str | None = None) -> DataFrame:
    """rows(i, t) -> (i, score); i may be of any type, also a struct that holds the text as `field`."""
    common.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = CharModel(model.counts)
        for batch in batches:
            texts = batch.column("i").field(field) if field else batch.column("t")
            out = [model.score(restored_words(x or "", letters)) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(out, pa.float64())], ["i", "score"])

    return rows.mapInArrow(common.tidy(run), T.StructType([rows.schema["i"], T.StructField("score", T.DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    model = fit(docs, labels, id_column=id_column, text_column=text_column, label_column=label_column)
    return score_rows(docs.select(F.struct(*docs.columns).alias("i")), model, text_column).where(F.col("score") < threshold).select("i.*")
