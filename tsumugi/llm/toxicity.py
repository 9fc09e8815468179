"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free_names, id_remainder, table

#: Bounds of the training sample: rows with label 1 and with label 0.
TOXIC_ROWS, CLEAN_ROWS = 3000, 6000
#: Bound of the lexicon.
ENTRIES = 3000
STEMS = (4, 5, 6)

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "ss"}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Phrases in which an entry means no harm.
EXCEPTIONS = ("trash can", "trash bag", "white trash bag", "clown fish", "sore loser board", "idiot proof", "idiot light", "pond scum", "soap scum")


class _Fold(dict):
    """Code point to folded text, filled as characters turn up (at most one entry for each of them)."""

    def __missing__(self, point: int) -> str:
        out = "".join(self.letter(c) for c in unicodedata.normalize("NFKD", chr(point)).lower() if not unicodedata.combining(c))
        self[point] = out = out if out or unicodedata.combining(chr(point)) else " "
        return out

    @staticmethod
    def letter(c: str) -> str:
        c = HOMOGLYPHS.get(c, SUBSTITUTES.get(c, c))
        return "i" if c == "l" else c if c.isalpha() else " "


_FOLDED = _Fold()


def fold(text: str | None) -> str:
    """Lower case without accents; look-alikes, digits and signs as the letters they stand for; l as i, both
    being written as 1; all else a space. With a space before and after."""
    return f" {(text or '').translate(_FOLDED)} "


@dataclass
class Lexicon:
    """weights: ' word ' or ' stem' in folded text to its log odds. b0 + b . features is the log odds of a text."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, ...] = (-4.0, 1.0, 0.0, 0.0)

    def automaton(self):
        """Of entries (weight) and exception phrases (weight None)."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            out.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            pattern = fold(phrase)
            out.add_word(pattern, (len(pattern), None))
        if len(out):
            out.make_automaton()
        return out


def hits(folded: str, automaton) -> tuple[float, int]:
    """Summed weights and number of words hit. A word counts once, with its heaviest entry, and not inside
    an exception phrase."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    if spared:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
    return sum(best.values()), len(best)


def features(folded: str, weight: float, n: int) -> tuple[float, float, float]:
    """Weight per word, log of the weight, and log of the number of words if anything is hit. Words are runs of
    letters, so that signs and spaces put in don't make a text longer."""
    words = len(folded.split()) if n else 1
    return (100 * weight / max(5, words) if n else 0.0, math.log1p(weight), math.log1p(words) if n else 0.0)


def score_of(f: tuple[float, float, float], coefficients: tuple[float, ...]) -> float:
    z = coefficients[0] + coefficients[1] * math.log1p(f[0]) + coefficients[2] * f[1] + coefficients[3] * f[2]
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps; the intercept is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    shrink = ridge * np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, toxic: str) -> dict[int, int]:
    """id to label: at most TOXIC_ROWS and CLEAN_ROWS ids of labels, by hash; repeated ids take the larger label."""
    one = labels.filter(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(doc_id).agg(F.max(toxic).alias("_y"))
    out: dict[int, int] = {}
    for y, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        out |= {r[0]: y for r in one.filter(F.col("_y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(most).collect()}
    return out


def terms_of(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}


def learn_lexicon(sample: DataFrame, toxic_rows: int, clean_rows: int, odds: float = 8.0, least: float = 0.004) -> dict[str, float]:
    """Terms (whole words, and stems of STEMS letters) to smoothed log odds of a text with them being toxic.

    sample: _text and _y. A term must be `odds` times as frequent among toxic texts, in `least` of them.
    A stem takes the place of the words and longer stems that start with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count[y].update(terms_of(fold(t)))
        terms = list(count[0].keys() | count[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([count[y][t] for t in terms], pa.int64()) for y in (0, 1))], names=["term", "clean", "toxic"])

    counts = sample.mapInArrow(run, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = ((F.col("toxic") + 0.5) / (toxic_rows + 1)) / ((F.col("clean") + 0.5) / (clean_rows + 1))
    rows = counts.filter((F.col("toxic") >= max(3, least * toxic_rows)) & (ratio >= odds)).withColumn("w", F.log(ratio)).orderBy(F.desc("w"), "term").limit(ENTRIES).collect()
    found = {r["term"]: r["w"] for r in rows}
    out: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (t.endswith(" "), len(t))):  # stems first, short ones first
        if not any(term[:k] in out for k in (1 + s for s in STEMS) if k < len(term)):
            out[term] = found[term]
    return out


def learn(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, toxic: str, exceptions: tuple[str, ...]) -> Lexicon:
    """Lexicon and coefficients from the bounded training sample; no labels of both kinds: an empty lexicon."""
    spark = docs.sparkSession
    chosen = training_rows(docs, labels, doc_id, toxic)
    n = (sum(v == 0 for v in chosen.values()), sum(v == 1 for v in chosen.values()))
    if not all(n):
        return Lexicon({}, exceptions)
    kind = labels.schema[doc_id].dataType.simpleString()
    ids = F.broadcast(spark.createDataFrame(list(chosen.items()), f"_key {kind}, _y int"))  # at most TOXIC_ROWS + CLEAN_ROWS
    sample = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text")).join(ids, "_key").select("_text", "_y")
    lexicon = Lexicon(learn_lexicon(sample, n[1], n[0]), exceptions)
    sent = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        for b in batches:
            folded = map(fold, b.column(0).to_pylist())
            f = [features(t, *hits(t, automaton)) for t in folded]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in f], pa.float64()) for k in range(3)), b.column(1)], names=["a", "b", "c", "y"])

    rows = sample.mapInArrow(run, "a double, b double, c double, y int").limit(2 * len(chosen)).collect()
    x, y = np.array([[math.log1p(r["a"]), r["b"], r["c"]] for r in rows]), np.array([r["y"] for r in rows], float)
    # Weights were learned from these very rows: shrink, so that rows the lexicon has not seen are judged alike.
    lexicon.coefficients = tuple(fit_logistic(x, y).tolist())
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs' columns but the text, with _score (0 to 1), _weight and _hits.

    Every whole text is folded and run through the automaton once. Null and empty texts score as texts
    without a hit. Other columns pass through, and where one has the name of an added column, the added one has an
    underscore more; repeated rows score alike; empty tables stay empty.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    added = free_names(kept, "_score", "_weight", "_hits")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias(free_names(kept, "_text")[0]))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        for b in batches:
            score, weight, n = [], [], []
            for t in b.column(len(keep)).to_pylist():
                folded = fold(t)
                w, k = hits(folded, automaton)
                score.append(score_of(features(folded, w, k), sent.value.coefficients))
                weight.append(w)
                n.append(k)
            made = [pa.array(score, pa.float64()), pa.array(weight, pa.float64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *made], names=[*keep, *added])

    return rows.mapInArrow(run, kept.schema.add(added[0], "double").add(added[1], "double").add(added[2], "long"))


def op4_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by score_toxicity() with a lexicon learned from the rows not held out; nulls, empty texts, repeated rows and empty tables as said there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(id_remainder(F.col("doc_id"), 4) != 2)
    lexicon = learn(docs, labels, "text", "doc_id", "toxic", EXCEPTIONS)
    df = score_toxicity(docs.withColumn("_held", id_remainder(F.col("doc_id"), 4) == 2), lexicon)
    return df.select("doc_id", F.col("_held").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))
