"""Whole results of op1, op2, op4, op10 and the pipeline against brute force on a small table."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import helpers as H
import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from test_native import brute_em, drawn, measured, poisson
from test_python import check_packing, jaccard_groups
from tokenizers import Tokenizer

from tsumugi.llm import brown, crf, quality, toxicity


def key(x):
    return tuple((v is None, v) for v in x)


# Quality


def all_measures(text):
    n_words, chars, symbols, dup, repeat = measured(text)
    lines = [x for x in (text or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    ended = sum(bool(regex.search(r"[.!?:;\"')\]][\x20\x09-\x0D]*$", x)) for x in lines)
    letters = len(regex.findall(r"[\p{L}\p{N}]", text or ""))
    return dict(zip(quality.MEASURES, (n_words, chars, symbols, dup, repeat, len(lines), ended, letters, len(regex.findall(r"[#*$%&|<>]+", text or ""))), strict=True))


def posteriors(texts):
    """The posterior of each text: votes by DuckDB, EM by plain loops over single texts."""
    db, votes = duckdb.connect(), []
    for t in texts:
        m = all_measures(t)
        names = ", ".join(f"{v} AS {k}" for k, v in m.items())
        cases = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in quality.RULES)
        votes.append(db.execute(f"SELECT {cases} FROM (SELECT {names})").fetchone())
    prior, tables = brute_em(votes, quality.STRENGTH, 300)
    out = []
    for v in votes:
        a, b = prior, 1 - prior
        for i, x in enumerate(v):
            a *= tables[0][i][x + 1]
            b *= tables[1][i][x + 1]
        out.append(a / (a + b))
    return out


def test_quality_verdicts(spark, tmp_path):
    data = H.rows()
    p = posteriors([t for _, t, *_ in data])
    want = []
    for (d, t, *_), q in zip(data, p, strict=True):
        m = measured(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.append((d, round(q, 6), not failed and q >= 0.5))
    got = [(r["doc_id"], round(r["posterior"], 6), r["kept"]) for r in quality.op2_weak_quality(spark, H.write_tables(spark, tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


# Toxicity


def test_toxicity_scores(spark):
    """Every text's score from its words one by one; the fit leaves no gradient."""
    lex = toxicity.Lexicon({" idiot": 3.0, " scum ": 2.5, " moron ": 1.0}, ("pond scum",), (-3.0, 1.2, 0.4, -0.1))
    for r in toxicity.score_toxicity(H.frame(spark, H.rows() + [(500, "Pond scum, you 1diot and scum - - - -", "en", "a", 1, True, "", "", "")]).select("doc_id", "text", F.col("text").alias("own")), lex).collect():
        words = toxicity.fold(r["own"]).split()
        weight = n = 0
        for i, w in enumerate(words):
            if (i + 1 < len(words) and words[i : i + 2] == ["pond", "scum"]) or (i and words[i - 1 : i + 1] == ["pond", "scum"]):
                continue
            own = max([v for p, v in lex.weights.items() if f" {w} ".startswith(p)], default=0.0)
            weight, n = weight + own, n + (own > 0)
        x = [1.0, math.log1p(100 * weight / max(5, len(words))), math.log1p(weight), math.log1p(len(words)) if n else 0.0]
        z = sum(a * b for a, b in zip(lex.coefficients, x, strict=True))
        assert r["_score"] == pytest.approx(1 / (1 + math.exp(-z))) and r["_hits"] == n
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=300) > 0.3).astype(float)
    w = toxicity.fit_logistic(x, y)
    one = np.column_stack([np.ones(300), x])
    gradient = one.T @ (y - 1 / (1 + np.exp(-one @ w))) - np.array([1e-6, 1, 1, 1]) * w
    assert np.abs(gradient).max() < 1e-5


def test_signs_do_not_dilute(spark):
    """Hyphens and spaces put between words change no score."""
    lex = toxicity.Lexicon({" idiot": 3.0}, ())
    texts = ["you idiot of the day", "you idiot of the day" + " -" * 4000, "you     idiot --- of the\n\n\nday !!!"]
    rows = toxicity.score_toxicity(spark.createDataFrame([(t,) for t in texts], "text string"), lex).collect()
    assert len({r["_score"] for r in rows}) == 1 and rows[0]["_hits"] == 1


# Language


def test_language_labels(spark):
    """Every text's label and score by forward-backward over its words one by one."""
    data = H.rows()
    texts = [(crf.words_in(t), lang) for _, t, lang, *_ in data[:30]]
    model = crf.train(texts, epochs=8)
    want = {}
    for d, t, *_ in data:
        words = crf.words_in(t)[:3000]
        if d is None or not words or len(crf.words_in(t)) > 3000:
            continue
        e, step, start = model.emissions(words), np.exp(model.transition), np.exp(model.start)
        e = np.exp(e - e.max(1, keepdims=True))
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        alpha[0] = start * e[0]
        for i in range(1, len(words)):
            a = (alpha[i - 1] / alpha[i - 1].sum()) @ step * e[i]
            alpha[i] = a
        for i in range(len(words) - 2, -1, -1):
            b = step @ (e[i + 1] * beta[i + 1])
            beta[i] = b / b.sum()
        g = alpha * beta
        total = (g / g.sum(1, keepdims=True)).sum(0)
        want[d] = (model.labels[int(total.argmax())], total.max() / len(words))
    got = {r["doc_id"]: (r["_lang"], r["_score"]) for r in crf.label_languages(H.frame(spark, data).select("doc_id", "text"), model).collect()}
    assert len(want) > 50
    for d, (lang, score) in want.items():
        assert got[d][0] == lang and got[d][1] == pytest.approx(score, abs=1e-6)


def test_training_sample(spark):
    """At most so many texts of a language, whole, the same however rows lie; repeated ids count once."""
    df = H.frame(spark).withColumn("_learn", F.lit(True))
    a = crf.training_sample(df, "_learn", "text", "lang", "doc_id", per_label=5)
    b = crf.training_sample(df.repartition(2), "_learn", "text", "lang", "doc_id", per_label=5)
    assert a == b and max(Counter(lang for _, lang in a).values()) <= 5
    whole = {" ".join(crf.words_in(t)) for _, t, *_ in H.rows()}
    assert all(" ".join(w) in whole for w, _ in a)


# LM scoring


def test_class_scores(spark, monkeypatch):
    """Every score from its words' classes and counts, one token after another."""
    kept = {}
    real = brown.class_sequences

    def spy(*args):
        kept["rows"] = real(*args)
        return kept["rows"]

    monkeypatch.setattr(brown, "class_sequences", spy)
    df = H.frame(spark, [r for r in H.rows() if r[0] is not None and r[0] < 80]).dropDuplicates(["doc_id"]).withColumn("_held", F.col("doc_id") % 5 == 0)
    size = brown.Size(clustered=30, endings=8, classes=6, local=60)
    got = {r["doc_id"]: r["score"] for r in brown.score_texts(df, "_held", size=size).collect()}
    texts = {r["doc_id"]: brown.tokens_of(r["text"]) for r in df.collect()}
    paths = {r["_id"]: (r["_held"], np.frombuffer(r["_path"], np.uint8)) for r in kept["rows"].collect()}
    count, cls, steps, members = Counter(), {}, np.zeros((6, 6)), defaultdict(set)
    for d, (held, path) in paths.items():
        assert len(path) == len(texts[d])
        for i, (w, c) in enumerate(zip(texts[d], path.tolist(), strict=True)):
            if held:
                continue
            assert c < brown.UNSEEN and cls.setdefault(w, c) == c  # one class for each training word
            count[w] += 1
            steps[path[i - 1], c] += 1
            members[c].add(w)
    share = (steps.sum(0) + brown.OPEN) / (steps.sum() + 6 * brown.OPEN)
    for d, (_, path) in paths.items():
        total = 0.0
        for i, w in enumerate(texts[d]):
            c, before = path[i] % brown.UNSEEN, path[i - 1] % brown.UNSEEN
            assert (w in count) == (path[i] < brown.UNSEEN)
            mass = count[w] - brown.DISCOUNT if w in count else brown.DISCOUNT * len(members[c]) + brown.OPEN
            total += math.log10((steps[before, c] + share[c]) / (steps[before].sum() + 1)) + math.log10(mass / (steps[:, c].sum() + brown.OPEN))
        assert got[d] == pytest.approx(total, rel=1e-6)


# Pipeline


def test_pipeline_rows(spark, tmp_path):
    """run()'s pieces, but for where they are packed, from the documents by plain loops over all five stages."""
    data = H.rows()
    folder = H.write_tables(spark, tmp_path)
    p = posteriors([t for _, t, *_ in data])
    docs = [r for r, q in zip(data, p, strict=True) if q >= 0.5 and (m := measured(r[1]))[0] and 100 * m[4] <= 50 * m[0]]
    best = {}
    for r in docs:  # the largest id of each text
        t = r[1] or ""
        if t not in best or (best[t][0] is None or (r[0] is not None and r[0] > best[t][0])):
            best[t] = r
    docs = list(best.values())
    groups = jaccard_groups(docs)
    first = {}
    for r in docs:  # the smallest id of each group
        g = groups[r[1]]
        if g not in first or (r[0] is None, r[0] or 0) < (first[g][0] is None, first[g][0] or 0):
            first[g] = r
    docs = list(first.values())
    n = Counter(r[3] for r in docs)
    library, want, nameless = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter(), 0
    for r in docs:
        if r[0] is None:
            nameless += 1
            continue
        copies = poisson(drawn(17, r[0]), len(docs) / len(n) / n[r[3]])
        ids = np.array([*library.encode(r[1], add_special_tokens=False).ids, 0], np.uint32)
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[(r[0], k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))] += copies
    rows = corpus_pipeline.run(spark, folder).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] is not None)
    assert got == +want and nameless <= 1
    check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, H.write_tables(spark, tmp_path, [])).count() == 0


def test_digests(spark, tmp_path):
    """The SHA-256 of every row of op6, nulls as empty."""
    from tsumugi.llm import exact

    folder = H.write_tables(spark, tmp_path)
    want = Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in H.rows())
    assert Counter(r["text_sha256"] for r in exact.op6_exact_dedup(spark, folder).collect()) == want
