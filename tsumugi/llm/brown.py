"""LM scoring by a Brown class bigram: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, id_remainder, table, written

END = b""
ALPHA, DISCOUNT, OPEN = 0.1, 0.5, 0.1
#: Marks a token's class where no training text holds the word.
UNSEEN = 128


@dataclass(frozen=True)
class Size:
    """The model's size. Every training word is counted and gets a class by exchange, whatever its rank.

    clustered: the core, the most frequent words, exchanged in turn on the driver. endings: units of all other
    words, by their hashed ending; only where these start from, and what unseen words go by. classes: 128 at
    most. local: at most so many words, the most frequent ones, have their counts and classes in every task;
    all others meet theirs in a shuffle join.
    """

    clustered: int = 2000
    endings: int = 256
    classes: int = 64
    local: int = 131_072

    @property
    def units(self) -> int:
        return self.clustered + self.endings

    def ending_unit(self, word: bytes) -> int:
        return self.clustered + zlib.crc32(word[-3:]) % self.endings


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then END."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word (binary) and n over all documents: counted in each task, a few hundred thousand words at a time, then summed."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                counts.update(tokens_of(t.as_py()))
                if len(counts) > 400_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    rows = docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words and their counts, most frequent first, as many whole count bands as fit into `most`.

    A histogram over bands of counts (64 to the octave, so some thousand rows) tells where to cut;
    then each task sends its words beyond the cut and nothing else. No task sees all candidates.
    """
    banded = counts.withColumn("band", F.floor(F.log2("n") * 64).cast("int"))
    total, cut = 0, None
    for band, words in sorted(((r["band"], r["count"]) for r in banded.groupBy("band").count().collect()), reverse=True):
        if total + words > most:
            break
        total, cut = total + words, band
    if cut is None:
        return {}
    top = banded.filter(F.col("band") >= cut).select("word", "n").toArrow()
    rows = sorted(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return dict(rows)


def exchange_clusters(left: np.ndarray, right: np.ndarray, count: np.ndarray, units: int, classes: int, rounds: int = 12) -> np.ndarray:
    """Class of each unit: words move one at a time to the class that raises the bigram likelihood most.

    left, right, count: the unit bigrams. Starts from ranks modulo classes; ends when a round moves
    no unit, or after `rounds`. The likelihood never falls. With N the class bigram counts, a class
    model's log-likelihood is, up to a constant, sum f(N) - sum f(row sums) - sum f(column sums),
    f(x) = x ln x.
    """
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    cls = (np.arange(units) % classes).astype(np.int32)
    freq = np.bincount(left, weights=count, minlength=units) + np.bincount(right, weights=count, minlength=units)
    by_left, by_right = np.argsort(left, kind="stable").astype(np.int32), np.argsort(right, kind="stable").astype(np.int32)
    starts_l, starts_r = np.searchsorted(left[by_left], np.arange(units + 1)), np.searchsorted(right[by_right], np.arange(units + 1))
    table_ = np.zeros((classes, classes))
    np.add.at(table_, (cls[left], cls[right]), count)
    for _ in range(rounds):
        moved = 0
        for u in np.argsort(-freq, kind="stable").tolist():
            if not freq[u]:
                break
            own_l, own_r = by_left[starts_l[u] : starts_l[u + 1]], by_right[starts_r[u] : starts_r[u + 1]]
            to, frm = right[own_l], left[own_r]
            twice = count[own_l][to == u].sum()  # u followed by itself
            succ = np.bincount(cls[to[to != u]], weights=count[own_l][to != u], minlength=classes)
            pred = np.bincount(cls[frm[frm != u]], weights=count[own_r][frm != u], minlength=classes)
            a = cls[u]
            table_[a] -= succ
            table_[:, a] -= pred
            table_[a, a] -= twice
            rows, cols = table_.sum(1) + pred, table_.sum(0) + succ  # these parts come back wherever u goes
            gain = (f(table_ + succ) - f(table_)).sum(1) + (f(table_.T + pred) - f(table_.T)).sum(1)
            d = np.diag(table_)  # on the diagonal both change at once
            gain += f(d + succ + pred + twice) - f(d + succ) - f(d + pred) + f(d)
            gain -= f(rows + succ.sum() + twice) - f(rows) + f(cols + pred.sum() + twice) - f(cols)
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            table_[best] += succ
            table_[:, best] += pred
            table_[best, best] += twice
            moved += best != a
            cls[u] = best
        if not moved:
            break
    return cls


def encode_documents(docs: DataFrame, text: str, doc_id: str, held: str, local: dict[bytes, int], size: Size) -> DataFrame:
    """A row for each document, with what the broadcast words settle; written to the shared folder.

    _row (unique), _id, _held, _n (tokens), _known, _base and _emit (sums over local words of
    log10(c + ALPHA) and log10(c - DISCOUNT)), _codes (int32 of each token: the place of a local word, or their
    number plus the ending of another one), _rare (the other words: word, unit, and where they stand).
    """
    import math

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(held).alias("_held"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    # Most frequent first, so that a word's place is its unit while it lasts.
    sent = spark.sparkContext.broadcast((list(local), list(local.values())))
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("unit", pa.int32()), ("at", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = sent.value
        place = {w: i for i, w in enumerate(words)}
        base = np.array([math.log10(c + ALPHA) for c in counts])
        emit = np.array([math.log10(c - DISCOUNT) for c in counts])
        shift = len(words) - size.clustered
        serial = TaskContext.get().partitionId() << 40
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column(2):
                tokens = tokens_of(t.as_py())
                at = np.fromiter((place.get(w, -1) for w in tokens), np.int32, len(tokens))
                known = at >= 0
                own = at[known]
                rare: dict[bytes, list[int]] = {}
                for i in np.nonzero(~known)[0].tolist():
                    rare.setdefault(tokens[i], []).append(i)
                listed = [{"word": w, "unit": size.ending_unit(w), "at": x} for w, x in rare.items()]
                for r in listed:
                    at[r["at"]] = shift + r["unit"]
                row = (serial, len(tokens), len(own), float(base[own].sum()), float(emit[own].sum()), at.tobytes(), listed)
                serial += 1
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), rare_type)
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([made[0], b.column(0), b.column(1), *made[1:]], names=["_row", "_id", "_held", "_n", "_known", "_base", "_emit", "_codes", "_rare"])

    return written(rows.mapInArrow(run, f"_row bigint, _id {kind}, _held boolean, _n bigint, _known bigint, _base double, _emit double, _codes binary, _rare array<struct<word:binary,unit:int,at:array<int>>>"), "encoded")


def joined_bytes(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column end to end as an array, and each value's length in elements."""
    parts = [x.as_py() for x in column]
    width = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(parts), dtype), np.array([len(x) // width for x in parts], np.int64)


def before(lengths: np.ndarray) -> np.ndarray:
    """For each token of texts laid end to end, where the token before it is; the first follows its text's END."""
    ends = np.cumsum(lengths)
    out = np.arange(-1, lengths.sum() - 1)
    out[ends - lengths] = ends - 1
    return out


def pair_counts(sequences: DataFrame, column: str, dtype: type, of: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right and count of the bigrams in the training rows' sequences; `of` turns what they hold into kinds.

    A task counts in one array of kinds squared.
    """
    sent = sequences.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kinds * kinds, np.int64)
        for b in batches:
            codes, lengths = joined_bytes(b.column(0), dtype)
            u = sent.value[codes].astype(np.int64)
            total += np.bincount(u[before(lengths)] * kinds + u, minlength=len(total))
        pairs = np.nonzero(total)[0]
        for at in range(0, len(pairs), 100_000):
            part = pairs[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["pair", "n"])

    rows = sequences.filter(~F.col("_held")).select(column).mapInArrow(run, "pair bigint, n bigint")
    grams = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = grams["pair"].to_numpy()
    return (pairs // kinds).astype(np.int32), (pairs % kinds).astype(np.int32), grams["n"].to_numpy().astype(np.float64)


def neighbours(encoded: DataFrame, start: np.ndarray, core: int, n_local: int, classes: int) -> DataFrame:
    """_place, _word and _met: the classes around each training word outside the core, in parts that add up.

    _place is a local word's place; other words have -1 and _word. _met holds uint32 entries, a code
    in the upper 8 bits and a count: code c for class c after the word, classes + c for class c before it, 2 * classes
    for the word after itself. start: the class of each code of encode_documents(). A local word gives a
    row for each task (or 8 million tokens, so that the counts fit), another word one for each document.
    """
    width = 2 * classes + 1
    sent = encoded.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, tokens = sent.value, 0
        total = np.zeros((n_local - core) * width, np.uint32)

        def record(places: np.ndarray, words: pa.Array, sizes: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
            met = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(entries.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), words, met], names=["_place", "_word", "_met"])

        def local_rows() -> Iterator[pa.RecordBatch]:
            cells = np.nonzero(total)[0]
            word = cells // width
            places, first = np.unique(word, return_index=True)
            entries = ((cells % width).astype(np.uint32) << 24) | total[cells]
            ends = np.append(first[1:], len(cells))
            for at in range(0, len(places), 10_000):
                lo, hi = first[at], ends[min(at + 10_000, len(places)) - 1]
                part = slice(at, at + 10_000)
                yield record(places[part] + core, pa.nulls(len(places[part]), pa.binary()), (ends - first)[part], entries[lo:hi])
            total[:] = 0

        for b in batches:
            codes, lengths = joined_bytes(b.column(0), np.int32)
            rare = b.column(1)
            words, _, at = rare.flatten().flatten()
            of_text = np.repeat(np.arange(len(lengths)), rare.value_lengths().to_numpy())  # of each rare word
            of_word = np.repeat(np.arange(len(words)), at.value_lengths().to_numpy())  # of each rare token
            here = at.flatten().to_numpy() + (np.cumsum(lengths) - lengths)[of_text][of_word]
            ident = codes.astype(np.int64)
            ident[here] = len(of) + of_word
            prior = before(lengths)
            after = np.empty_like(prior)
            after[prior] = np.arange(len(prior))
            cls = of[codes].astype(np.int64)

            def cells(tokens: np.ndarray, own: np.ndarray) -> np.ndarray:
                twice = ident[after[tokens]] == ident[tokens]
                once = ident[prior[tokens]] != ident[tokens]
                return np.concatenate([own * width + np.where(twice, 2 * classes, cls[after[tokens]]), (own * width + classes + cls[prior[tokens]])[once]])

            near = np.nonzero((codes >= core) & (codes < n_local))[0]
            np.add.at(total, cells(near, codes[near].astype(np.int64) - core), np.uint32(1))
            if len(words):
                keys, n = np.unique(cells(here, of_word), return_counts=True)
                sizes = np.bincount(keys // width, minlength=len(words))
                yield record(np.full(len(words), -1), words, sizes, ((keys % width).astype(np.uint32) << 24) | n.astype(np.uint32))
            tokens += len(codes)
            if tokens > 8_000_000:
                yield from local_rows()
                tokens = 0
        yield from local_rows()

    return encoded.filter(~F.col("_held")).select("_codes", "_rare").mapInArrow(run, "_place int, _word binary, _met binary")


def exchange_all(table_: np.ndarray, own: np.ndarray, row: np.ndarray, code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood most for each of many words, each moved alone as exchange_clusters() would.

    table_: the class bigrams, the words' own included. own: the words' classes now. row, code, count:
    what neighbours() says of them, added up, in order of row and code.
    """
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    classes, words = len(table_), np.arange(len(own))
    dense = np.zeros((len(own), 2 * classes + 1))
    dense[row, code] = count
    succ, pred, twice = dense[:, :classes], dense[:, classes:-1], dense[:, -1]
    gain = np.zeros((len(own), classes))
    for side, other, here in ((table_.T, pred, code < classes), (table_, succ, (code >= classes) & (code < 2 * classes))):
        r, c, n = row[here], code[here] % classes, count[here]
        if not len(r):
            continue
        cell = side[c]  # for each entry the cells of all classes, without the word
        cell[np.arange(len(r)), own[r]] -= n
        mine = np.nonzero(c == own[r])[0]
        cell[mine] -= other[r[mine]]
        cell[mine, own[r[mine]]] -= twice[r[mine]]
        starts = np.nonzero(np.diff(r, prepend=-1))[0]
        gain[r[starts]] += np.add.reduceat(f(cell + n[:, None]) - f(cell), starts, axis=0)
    diagonal = np.tile(np.diag(table_), (len(own), 1))  # here both change at once
    diagonal[words, own] -= succ[words, own] + pred[words, own] + twice
    gain += f(diagonal + succ + pred + twice[:, None]) - f(diagonal + succ) - f(diagonal + pred) + f(diagonal)
    for sums, n in ((table_.sum(1), succ.sum(1) + twice), (table_.sum(0), pred.sum(1) + twice)):
        rest = np.tile(sums, (len(own), 1))
        rest[words, own] -= n
        gain -= f(rest + n[:, None]) - f(rest)
    best = gain.argmax(1)
    return np.where(gain[words, best] > gain[words, own] + 1e-9, best, own)


def word_classes(met: DataFrame, table_: np.ndarray, start: np.ndarray, cls: np.ndarray, n_local: int, size: Size) -> DataFrame:
    """_place, _word, _unit, _class and _c (its count) of each training word outside the core; written to the shared folder.

    All words move at once, each against the class bigrams that the core's exchange ended with.
    """
    sent = met.sparkSession.sparkContext.broadcast((table_, start, cls))
    width = 2 * size.classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, start, cls = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            place, words, parts = b.column(0).to_numpy(), b.column(1), b.column(2)
            entries, lengths = joined_bytes(parts.flatten(), np.uint32)
            of_word = np.repeat(np.repeat(np.arange(len(place)), parts.value_lengths().to_numpy()), lengths)
            keys, at = np.unique(of_word * width + (entries >> 24), return_inverse=True)
            count = np.bincount(at, weights=entries & 0xFFFFFF, minlength=len(keys))
            row, code = keys // width, keys % width
            unit = np.array([-1 if w is None else size.ending_unit(w) for w in words.to_pylist()], np.int32)
            own = np.where(place < 0, cls[unit], start[np.maximum(place, 0)]).astype(np.int64)
            best = exchange_all(table_, own, row, code, count)
            follows = (code < size.classes) | (code == 2 * size.classes)  # every token has one successor
            n = np.bincount(row[follows], weights=count[follows], minlength=len(place)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), words, pa.array(unit), pa.array(best.astype(np.int32)), pa.array(n)], names=["_place", "_word", "_unit", "_class", "_c"])

    grouped = met.groupBy("_place", "_word").agg(F.collect_list("_met").alias("_met"))
    return written(grouped.mapInArrow(run, "_place int, _word binary, _unit int, _class int, _c bigint"), "word-classes")


def class_sequences(encoded: DataFrame, classes: DataFrame, of: np.ndarray) -> DataFrame:
    """_id, _held, _n, _known, _base, _emit, now over all words, and _path: a byte for each token; written to the shared folder.

    The byte is the class, and UNSEEN besides where no training text holds the word. of: the bytes
    of encode_documents()'s codes, words that aren't local taken as unseen.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(of)
    plain = ["_row", "_id", "_held", "_n", "_known", "_base", "_emit"]

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sent.value[np.frombuffer(x.as_py(), np.int32)].tobytes() for x in b.column(len(plain))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(plain)], pa.array(made, pa.binary())], names=[*plain, "_path"])

    paths = encoded.select(*plain, "_codes").mapInArrow(path, encoded.select(*plain).schema.add("_path", "binary"))
    rare = encoded.select("_row", F.explode("_rare").alias("r")).select("_row", F.col("r.word").alias("_word"), F.col("r.at").alias("_at"))
    met = rare.join(classes.filter("_place < 0").select("_word", "_class", "_c"), "_word", "left")
    seen, times = F.col("_c").isNotNull(), F.size("_at")
    sums = met.groupBy("_row").agg(
        F.sum(F.when(seen, times).otherwise(0)).alias("_known2"),
        F.sum(times * F.log10(F.coalesce("_c", F.lit(0)) + ALPHA)).alias("_base2"),
        F.sum(F.when(seen, times * F.log10(F.col("_c") - DISCOUNT)).otherwise(0.0)).alias("_emit2"),
        F.collect_list(F.when(seen, F.struct("_at", "_class"))).alias("_patches"),
    )
    more = lambda c: (F.col(c) + F.coalesce(F.col(f"{c}2"), F.lit(0))).alias(c)
    rows = paths.join(sums, "_row", "left").select("_id", "_held", "_n", more("_known"), more("_base"), more("_emit"), "_path", F.coalesce("_patches", F.array()).alias("_patches"))

    def patch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, lengths = joined_bytes(b.column(6), np.uint8)
            tokens, ends = tokens.copy(), np.cumsum(lengths)
            at, cls = b.column(7).flatten().flatten()
            of_text = np.repeat(np.arange(len(lengths)), b.column(7).value_lengths().to_numpy())
            of_word = np.repeat(np.arange(len(cls)), at.value_lengths().to_numpy())
            tokens[at.flatten().to_numpy() + (ends - lengths)[of_text][of_word]] = cls.to_numpy()[of_word]
            made = [tokens[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(made, pa.binary())], names=[*plain[1:], "_path"])

    return written(rows.mapInArrow(patch, rows.drop("_patches").schema), "class-sequences")


def path_scores(sequences: DataFrame, log_step: np.ndarray, log_total: np.ndarray, log_unseen: np.ndarray) -> DataFrame:
    """sequences with _path turned into a number: class transitions less the emissions' denominators, and the unseen words' emissions."""
    sent = sequences.sparkSession.sparkContext.broadcast((log_step - log_total[None, :], log_unseen))
    keep = [c for c in sequences.columns if c != "_path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, unseen = sent.value
        for b in batches:
            sums = []
            for x in b.column(len(keep)):
                t = np.frombuffer(x.as_py(), np.uint8)
                c = t & (UNSEEN - 1)
                sums.append(float(step[np.concatenate([c[-1:], c[:-1]]), c].sum() + unseen[c[t >= UNSEEN]].sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sums, pa.float64())], names=[*keep, "_path"])

    return sequences.select(*keep, "_path").mapInArrow(run, sequences.select(*keep).schema.add("_path", "double"))


def score_texts(docs: DataFrame, held: str, text: str = "text", doc_id: str = "doc_id", size: Size | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    held: a boolean column; the model learns from the other rows, all of them and whole.

    1. Every word's count. 2. The most frequent words go to all tasks, a bounded table; one
    pass writes each document's words as numbers, the sums over local words, and its other words.
    3. Unit bigrams over all training documents; their number is bounded by the square of the
    model's units (some 100 MB at most), so the exchange clustering of the core and the endings runs on the driver.
    4. All other training words are exchanged once, distributedly: each starts in its ending's
    class and moves, by the classes around all its occurrences, to where the likelihood gains most. 5. Words
    that aren't local join their class and count by word; each document's class sequence is written.
    6. Class bigrams are counted over these sequences, and the transitions scored.

    log10 P(w | class) is log10((c - DISCOUNT) / (total + OPEN)) for a word with count c, and the mass
    so set free, plus OPEN, for all unseen words of the class together; an unseen word's class is the one most
    training words of its ending have. P(class | class before) interpolates with the class's own share. base_score is the additive unigram.

    Null and empty texts are one END. Null ids pass through; repeated rows are scored one by one.
    No training rows: counts are zero, and both scores follow from that. An empty table gives an
    empty table; other columns are not read.
    """
    spark, size = docs.sparkSession, size or Size()
    counts = written(word_counts(docs.filter(~F.col(held)), text), "word-counts")
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    local = frequent_words(counts, size.local)
    n_local, core, classes = len(local), min(len(local), size.clustered), size.classes
    encoded = encode_documents(docs, text, doc_id, held, local, size)

    unit = np.concatenate([np.array([i if i < core else size.ending_unit(w) for i, w in enumerate(local)], np.int32), np.arange(size.clustered, size.units, dtype=np.int32)])
    left, right, n = pair_counts(encoded, "_codes", np.int32, unit, size.units)
    cls = exchange_clusters(left, right, n, size.units, classes)
    steps = np.zeros((classes, classes))
    np.add.at(steps, (cls[left], cls[right]), n)
    del left, right, n

    start = cls[unit].astype(np.uint8)
    words = word_classes(neighbours(encoded, start, core, n_local, classes), steps, start, cls, n_local, size)
    of = start.copy()
    known = words.filter("_place >= 0").select("_place", "_class").toArrow()
    of[known["_place"].to_numpy()] = known["_class"].to_numpy()
    # Word types of each class, and by ending.
    by_ending = np.zeros((size.endings, classes), np.int64)
    np.add.at(by_ending, (unit[core:n_local] - size.clustered, of[core:n_local]), 1)
    for r in words.filter("_place < 0").groupBy("_unit", "_class").count().collect():
        by_ending[r["_unit"] - size.clustered, r["_class"]] += r["count"]
    kinds_in_class = np.bincount(of[:core], minlength=classes) + by_ending.sum(0)
    of[n_local:] = np.where(by_ending.any(1), by_ending.argmax(1), of[n_local:]) | UNSEEN

    sequences = class_sequences(encoded, words, of)
    left, right, n = pair_counts(sequences, "_path", np.uint8, np.arange(2 * UNSEEN) % UNSEEN, classes)
    steps = np.zeros((classes, classes))
    steps[left, right] = n
    share = (steps.sum(0) + OPEN) / (steps.sum() + OPEN * classes)
    log_step = np.log10((steps + share[None, :]) / (steps.sum(1, keepdims=True) + 1))
    log_total, log_unseen = np.log10(steps.sum(0) + OPEN), np.log10(DISCOUNT * kinds_in_class + OPEN)

    out = path_scores(sequences, log_step, log_total, log_unseen)
    denominator = np.log10(total + ALPHA * (kinds + 1))
    base = F.col("_base") - F.col("_n") * float(denominator)
    score = F.col("_path") + F.col("_emit")
    return out.select(
        F.col("_id").alias(doc_id), F.col("_held").alias("held_out"), F.col("_n").alias("n_tokens"), F.col("_known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("_n")).alias("perplexity"),
    )


def op10_brown_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by score_texts(); nulls, empty and long texts, ties, repeated rows and empty tables as said there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("_held_out", id_remainder(F.col("doc_id"), 10) == 0)
    return score_texts(docs, "_held_out").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
