"""Language of words and texts by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, by_size, free_names, id_remainder, table

#: Buckets of hashed n-gram weights.
BUCKETS = 1 << 17
#: Longest n-gram, in UTF-8 bytes; with the blanks around a word, its affixes are among them.
NGRAM = 4
BLOCK = 128
#: Bounds of the training sample: documents and characters (beyond the first document) of each language, and languages, the most frequent ones.
DOCS_PER_LANGUAGE = 150
CHARS_PER_LANGUAGE = 2_000_000
LANGUAGES = 256
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> list[str]:
    """Runs of letters in lower case; none where no character is a letter."""
    if not text or not any(map(str.isalpha, text)):
        return []
    return _WORD.findall(text.lower())


@dataclass
class Crf:
    labels: list[str]
    ngrams: np.ndarray  # (BUCKETS, labels)
    lexicon: dict[str, int]
    lexical: np.ndarray  # (lexicon, labels)
    transition: np.ndarray  # (labels, labels)
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        owner, bucket = ngram_features(words)
        out = np.empty((len(words), len(self.labels)))
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(owner, weights=self.ngrams[bucket, k], minlength=len(words))
        at = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        out[at >= 0] += self.lexical[at[at >= 0]]
        return out

    def word_posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """P(label) of each word of each text, by forward-backward over the text."""
        place: dict[str, int] = {}
        ids = np.fromiter((place.setdefault(w, len(place)) for t in texts for w in t), np.int64)
        sizes = [len(t) for t in texts]
        if not len(ids):
            return [np.zeros((0, len(self.labels)))] * len(texts)
        first = np.zeros(len(ids), bool)
        first[[e - n for e, n in zip(np.cumsum(sizes).tolist(), sizes, strict=True) if n]] = True
        gamma, _ = forward_backward(self.emissions(list(place))[ids], first, self.transition, self.start)
        return np.split(gamma, np.cumsum(sizes)[:-1])


def ngram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of the bytes of ' word '."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = [b" " + w.encode("utf-8", "surrogatepass") + b" " for w in words]
    owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    owners, buckets = [], []
    code = np.zeros(len(flat), np.uint64)
    for n in range(1, NGRAM + 1):
        size = len(flat) - n + 1
        if size <= 0:
            break
        code = code[:size] * np.uint64(257) + flat[n - 1 :] + np.uint64(1)
        inside = owner[:size] == owner[n - 1 :]
        mixed = (code[inside] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        owners.append(owner[:size][inside])
        buckets.append((mixed >> np.uint64(64 - 17)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def forward_backward(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (n, labels) and expected transitions (labels, labels), exact.

    All sequences lie one after another; first marks where one starts. The chain is cut into blocks of
    BLOCK words. Step by step for all blocks at once, each block's product of transition matrices is
    formed; the products chain the blocks; then messages run inside all blocks at once.
    """
    n, labels = emission.shape
    blocks = -(-n // BLOCK)
    e = np.ones((blocks * BLOCK, labels))
    e[:n] = np.exp(emission - emission.max(1, keepdims=True))
    reset = np.ones(blocks * BLOCK, bool)
    reset[:n] = first
    e, reset = e.reshape(blocks, BLOCK, labels), reset.reshape(blocks, BLOCK)
    step = np.exp(transition - transition.max())
    begin = np.broadcast_to(np.exp(start - start.max()), (labels, labels))

    def matrix(s: int) -> np.ndarray:
        return np.where(reset[:, s, None, None], begin, step) * e[:, s, None, :]

    product = np.broadcast_to(np.eye(labels), (blocks, labels, labels))
    for s in range(BLOCK):
        product = product @ matrix(s)
        product = product / product.sum((1, 2), keepdims=True)
    into, out_of = np.empty((blocks, labels)), np.empty((blocks, labels))
    v = np.full(labels, 1 / labels)
    for b in range(blocks):
        into[b] = v
        v = v @ product[b]
        v = v / v.sum()
    v = np.full(labels, 1 / labels)
    for b in range(blocks - 1, -1, -1):
        out_of[b] = v
        v = product[b] @ v
        v = v / v.sum()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = into
    for s in range(BLOCK):
        a = np.where(reset[:, s, None], begin[0], a @ step) * e[:, s]
        a = a / a.sum(1, keepdims=True)
        alpha[:, s] = a
    z = out_of
    for s in range(BLOCK - 1, -1, -1):
        beta[:, s] = z
        w = e[:, s] * z
        z = np.where(reset[:, s, None], (w * begin[0]).sum(1, keepdims=True), w @ step.T)
        z = z / z.sum(1, keepdims=True)
    alpha, beta, flat = alpha.reshape(-1, labels)[:n], beta.reshape(-1, labels)[:n], e.reshape(-1, labels)[:n]
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    inner = np.nonzero(~first)[0]
    left, right = alpha[inner - 1], flat[inner] * beta[inner]
    norm = ((left @ step) * right).sum(1, keepdims=True)
    return gamma, step * (left.T @ (right / norm))


def train(texts: list[tuple[list[str], str]], epochs: int = 40, rate: float = 0.08, span: int = 24, seed: int = 11, l2: float = 1e-4) -> Crf:
    """Maximum likelihood by Adam over the given labelled texts, for words that all carry their text's label.

    Sequences are spliced from spans of about `span` words of random texts, so that transitions learn
    from code-switched text. The lexicon is the words seen three times or more.
    """
    labels = sorted({label for _, label in texts})
    rng = np.random.default_rng(seed)
    spans = []
    for words, label in texts:
        at = 0
        while at < len(words):
            size = int(rng.integers(1, 2 * span))
            spans.append((words[at : at + size], labels.index(label)))
            at += size
    rng.shuffle(spans)
    place: dict[str, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for ws, _ in spans for w in ws], np.int64)
    truth = np.repeat([k for _, k in spans], [len(ws) for ws, _ in spans])
    first = np.zeros(len(ids), bool)
    edges = np.cumsum([0, *(len(ws) for ws, _ in spans)])[:-1]
    first[edges[:: 8]] = True  # eight spans a sequence
    seen = Counter(w for ws, _ in spans for w in ws)
    lexicon = {w: i for i, w in enumerate(sorted(w for w, c in seen.items() if c >= 3))}
    model = Crf(labels, np.zeros((BUCKETS, len(labels))), lexicon, np.zeros((len(lexicon), len(labels))), np.zeros((len(labels),) * 2), np.zeros(len(labels)))
    if not len(ids):
        return model
    words = list(place)
    owner, bucket = ngram_features(words)
    at = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    goal = np.eye(len(labels))[truth]
    inner = np.nonzero(~first)[0]
    steps = np.zeros_like(model.transition)
    np.add.at(steps, (truth[inner - 1], truth[inner]), 1)
    params = [model.ngrams, model.lexical, model.transition, model.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, epochs + 1):
        emission = np.empty((len(words), len(labels)))
        for k in range(len(labels)):
            emission[:, k] = np.bincount(owner, weights=model.ngrams[bucket, k], minlength=len(words))
        emission[at >= 0] += model.lexical[at[at >= 0]]
        gamma, moved = forward_backward(emission[ids], first, model.transition, model.start)
        by_word = np.stack([np.bincount(ids, weights=(goal - gamma)[:, k], minlength=len(words)) for k in range(len(labels))], 1)
        ngram_up = np.stack([np.bincount(bucket, weights=by_word[owner, k], minlength=BUCKETS) for k in range(len(labels))], 1)
        lexical_up = np.zeros_like(model.lexical)
        lexical_up[at[at >= 0]] = by_word[at >= 0]
        for p, (m, v), up in zip(params, moments, (ngram_up, lexical_up, steps - moved, (goal - gamma)[first].sum(0)), strict=True):
            g = up / len(ids) - l2 * p / len(ids)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


def training_sample(docs: DataFrame, learn: str, text: str, label: str, doc_id: str, per_label: int = DOCS_PER_LANGUAGE) -> list[tuple[list[str], str]]:
    """Whole texts of at most per_label rows of each label among the rows where learn holds, chosen by hash of the id.

    One pass ranks ids and sizes (each task sends its first per_label rows of a label at most); a second fetches the
    chosen texts, CHARS_PER_LANGUAGE of a label or one text. Of rows that repeat id and label the least text is taken.
    """
    rows = docs.filter(F.col(learn) & F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    rows = rows.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label"), F.col(text).cast("string").alias("_text"))
    labels = [r[0] for r in rows.groupBy("_label").count().orderBy(F.desc("count"), "_label").limit(LANGUAGES).collect()]
    rank = F.row_number().over(Window.partitionBy("_label").orderBy("_h", "_id", "_size"))
    sized = rows.filter(F.col("_label").isin(labels)).select("_id", "_label", F.char_length("_text").alias("_size"), F.xxhash64("_id").alias("_h"))
    chosen, chars = [], Counter()
    for r in sized.withColumn("_rank", rank).filter(F.col("_rank") <= per_label).orderBy("_label", "_rank").collect():
        if not chars[r["_label"]] or chars[r["_label"]] + r["_size"] <= CHARS_PER_LANGUAGE:
            chosen.append((r["_id"], r["_label"]))
            chars[r["_label"]] += r["_size"]
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(sorted(set(chosen)), rows.select("_id", "_label").schema)
    texts = rows.join(F.broadcast(wanted), ["_id", "_label"]).groupBy("_label", "_id").agg(F.min("_text").alias("_text")).orderBy("_label", "_id").collect()
    return [x for x in ((words_in(r["_text"]), r["_label"]) for r in texts) if x[0]]


def label_languages(docs: DataFrame, model: Crf, text: str = "text", with_words: bool = False) -> DataFrame:
    """docs' columns but the text, with _lang, _score (and _words: word, lang, p of each word).

    _lang has the largest sum of word posteriors over the whole text, _score its share. Null texts and
    texts without a letter: 'und', score 0. Ties go to the first label in order. Without labels to
    learn from, every text is 'und'. Other columns pass through, and where one has the name of an added column, the
    added one has an underscore more; repeated rows are labelled alike; empty tables give empty tables. Texts of some
    megabytes together are labelled at once; a longer one is labelled whole, by itself.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    added = free_names(kept, "_lang", "_score", *["_words"] * with_words)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias(free_names(kept, "_text")[0]))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    word_type = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf: Crf = sent.value
        for b in batches:
            given = b.column(len(keep)).to_pylist()
            langs, scores, listed = [], [], []
            for at, end in by_size(given):
                texts = [words_in(t) for t in given[at:end]]
                for words, p in zip(texts, crf.word_posteriors(texts) if crf.labels else [None] * len(texts), strict=True):
                    if words and crf.labels:
                        total = p.sum(0)
                        best = int(np.argmax(total))
                        langs.append(crf.labels[best])
                        scores.append(min(1.0, float(total[best] / len(words))))
                    else:
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                    if with_words:
                        listed.append([{"word": w, "lang": crf.labels[int(np.argmax(q))], "p": float(q.max())} for w, q in zip(words, p, strict=True)] if words and crf.labels else [])
            made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())] + ([pa.array(listed, word_type)] if with_words else [])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *made], names=[*keep, *added])

    schema = kept.schema.add(added[0], "string").add(added[1], "double")
    if with_words:
        word = T.StructType().add("word", "string").add("lang", "string").add("p", "double")
        schema = schema.add(added[2], T.ArrayType(word))
    return rows.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, learn: str, text: str = "text", label: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Trains on a bounded sample of the rows where learn holds, then labels every text."""
    model = train(training_sample(docs, learn, text, label, doc_id))
    return label_languages(docs.select(doc_id, learn, text), model, text)


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by label_languages(), learned from the rows not held out; nulls, empty and long texts, ties, repeated rows and empty tables as said there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("_learn", id_remainder(F.col("doc_id"), 5) != 0)
    df = identify_languages(docs, "_learn")
    return df.select("doc_id", (~F.col("_learn")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
