"""Quality rules, mixing, exact dedup, license scans."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import helpers as H
import pytest

from tsumugi.llm import exact, licenses, mixing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return H.write_tables(spark, tmp_path_factory.mktemp("native"))


def measured(text):
    w = H.words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked))


def test_quality_measures(spark, folder):
    got = quality.op2_weak_quality(spark, folder).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    base = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got]
    want = [(d, *(m := measured(t)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for d, t, *_ in H.rows()]
    assert sorted(base, key=key) == sorted(want, key=key)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    prose = [r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 60 and not r["base_failed"]]
    assert prose and all(prose)


def brute_em(docs, strength, rounds):
    """The same posterior by plain loops over single documents' votes."""
    k, start, expected = len(docs[0]), 0.8, quality.EXPECTED
    prior, tables = start, [[list(e) for _ in range(k)] for e in expected]
    for _ in range(rounds):
        p = []
        for v in docs:
            a, b = prior, 1 - prior
            for i, x in enumerate(v):
                a *= tables[0][i][x + 1]
                b *= tables[1][i][x + 1]
            p.append(a / (a + b))
        held = [strength * len(docs) * start, strength * len(docs) * (1 - start)]
        for y, q in ((0, p), (1, [1 - x for x in p])):
            for i in range(k):
                s = [held[y] * expected[y][j] + sum(w for w, v in zip(q, docs, strict=True) if v[i] == j - 1) for j in range(3)]
                tables[y][i] = [x / sum(s) for x in s]
        prior = (held[0] + sum(p)) / (len(docs) * (1 + strength))
    return prior, tables


def test_em():
    import random

    rng = random.Random(1)
    docs = []
    for _ in range(600):
        good = rng.random() < 0.7
        docs.append(tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < acc) == good else -1) for acc in (0.9, 0.8, 0.7, 0.95)))
    histogram = list(Counter(docs).items())
    model = quality.fit_votes(histogram, rounds=40)
    prior, tables = brute_em(docs, quality.STRENGTH, 40)
    assert model.prior == pytest.approx(prior, abs=1e-6)
    for i in range(4):
        assert model.good[i] == pytest.approx(tables[0][i], abs=1e-6) and model.bad[i] == pytest.approx(tables[1][i], abs=1e-6)
    free = quality.fit_votes(histogram, strength=0.001)
    assert abs(free.prior - 0.7) < 0.08
    assert [free.accuracy(i) for i in range(4)] == pytest.approx([0.9, 0.8, 0.7, 0.95], abs=0.08)
    assert quality.fit_votes([]).prior == 0.8
    ten = quality.fit_votes([(v, 10 * c) for v, c in histogram], rounds=40)
    assert ten.prior == pytest.approx(model.prior)  # tables of any size are judged alike


def test_quality_pipeline_form(spark):
    df = H.frame(spark)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    assert quality.keep_good(df.limit(0)).count() == 0


def exact_expected(data):
    groups = defaultdict(list)
    for d, t, *_ in data:
        groups[t or ""].append(d)
    out = []
    for d, t, *_ in data:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append([d, keep, len(ids), False, hashlib.sha256((t or "").encode()).hexdigest()])
    best = {}
    for r in out:  # of rows that repeat text and id, one stays
        best.setdefault((r[4], r[1]), r)
        if r[0] == r[1] and not best[(r[4], r[1])][3]:
            r[3], best[(r[4], r[1])] = True, r
    return [tuple(r) for r in out]


def key(x):
    return tuple((v is None, v) for v in x)


@pytest.mark.parametrize("capacity", [65536, 3, 1])
def test_exact(spark, capacity):
    got = exact.mark_exact(H.frame(spark), capacity=capacity)
    rows = [tuple(r) for r in got.select("doc_id", "_keep_id", "_n", "_kept", "_sha").collect()]
    assert sorted(rows, key=key) == sorted(exact_expected(H.rows()), key=key)


def test_exact_query_and_empty(spark, folder):
    assert sorted(map(tuple, exact.op6_exact_dedup(spark, folder).collect()), key=key) == sorted(exact_expected(H.rows()), key=key)
    df = H.frame(spark)
    assert exact.drop_exact(df.limit(0)).count() == 0
    left = exact.drop_exact(df)
    assert left.columns == df.columns
    assert {r["text"] or "" for r in left.collect()} == {t or "" for _, t, *_ in H.rows()}


@pytest.mark.parametrize("capacity", [3, 100, 5000])
def test_directory_splits_overfull_buckets(spark, capacity):
    keys = spark.range(2000).selectExpr("xxhash64(id) as _key")
    directory = exact.build_directory(keys, capacity)
    rows = directory.collect()
    # No bucket holds another, and together they cover all keys; a bucket's parent was overfull.
    assert len(set(map(tuple, rows))) == len(rows)
    sizes = Counter(r["_bucket"] for r in exact.to_buckets(keys, directory).collect())
    assert None not in sizes and max(sizes.values()) <= capacity and sum(sizes.values()) == 2000
    assert (len(rows) == 1) == (capacity == 5000)
    own = lambda k, d: ((k & (2**64 - 1)) >> (64 - d)) if d else 0
    values = [r["_key"] for r in keys.collect()]
    for r in rows:
        n = sum(own(k, r["_depth"] - 1) == r["_prefix"] >> 1 for k in values) if r["_depth"] else 0
        assert r["_depth"] == 0 or n > capacity


def test_directory_of_close_keys(spark):
    """Keys that differ in their last bits alone need all 64 doublings; equal keys are one key."""
    keys = spark.createDataFrame([(k,) for k in range(8)], "_key bigint")
    directory = exact.build_directory(keys, 1)
    sizes = Counter(r["_bucket"] for r in exact.to_buckets(keys, directory).collect())
    assert max(r["_depth"] for r in directory.collect()) == 64 and sorted(sizes.values()) == [1] * 8


def poisson(u, rate):
    k, p, s = 0, math.exp(-rate), math.exp(-rate)
    while s <= u:
        k += 1
        p *= rate / k
        s += p
        if k > rate + 12 * math.sqrt(rate) + 24:
            break
    return k


def drawn(*parts):
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


@pytest.mark.parametrize("rate, rare", [(700, 20), (740, 20), (800, 20), (100_000, 2)])
def test_mixing_at_high_rates(spark, tmp_path, rate, rare):
    """Against the Poisson quantile from log-gamma terms."""
    spark.range(2 * rate * rare).selectExpr("id as doc_id", f"if(id < {rare}, 'rare', 'hot') as source").write.parquet(f"{tmp_path}/docs")
    got = Counter(r["doc_id"] for r in mixing.mix(spark.read.parquet(f"{tmp_path}/docs")).filter("source = 'rare'").select("doc_id").collect())

    def quantile(u):
        s = 0.0
        for k in range(max(0, int(rate - 15 * math.sqrt(rate))), int(rate + 15 * math.sqrt(rate))):
            s += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            if s > u:
                return k

    assert got == {d: quantile(drawn(17, d)) for d in range(rare)}


@pytest.mark.parametrize("weights", [None, {"hot": 1.0, "a": 3.0}])
def test_mixing(spark, weights):
    data = H.rows()
    n = Counter(r[3] for r in data)
    share = {s: 1 / len(n) for s in n} if weights is None else {s: weights.get(s, 0) / 4 for s in n}
    want = Counter()
    for r in data:
        rate = len(data) * share[r[3]] / n[r[3]]
        for c in range(poisson(drawn(17, r[0]), rate) if rate and r[0] is not None else 0):
            want[(r[0], r[1], c, drawn(17, r[0], c))] += 1
    df = mixing.mix(H.frame(spark), weights=weights)
    got = Counter((r["doc_id"], r["text"], r["_copy"], r["_order"]) for r in df.filter("doc_id is not null").collect())
    assert got == want
    order = [r["_order"] for r in df.select("_order").collect()]
    assert order == sorted(order)
    assert mixing.mix(H.frame(spark).limit(0)).count() == 0


def license_expected(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", H.lower(text)) if x]
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark, folder):
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.op8_license_diagonals(spark, folder).collect()]
    want = [(d, *license_expected(t)) for d, t, *_ in H.rows()]
    assert sorted(got, key=key) == sorted(want, key=key)


def spans_of(spark, text):
    data = [(1, text, "en", "a", 1, True, "", "", "")]
    return licenses.scan_licenses(H.frame(spark, data)).first()


def test_license_spans(spark):
    r = spans_of(spark, "first words. Licensed under CC BY-NC 4.0. then more")
    assert (r["base_labels"], r["labels"]) == ("", "cc-by-nc") and r["spans"][0]["start"] == 2 and r["spans"][0]["end"] == 9
    assert 0.8 <= r["score"] <= 1
    bsd = next(t for label, t in licenses.TEMPLATES if label == "bsd")
    r = spans_of(spark, "x " + bsd.replace("source and", "source code and"))  # a word put in: two diagonals merge
    assert r["labels"] == "bsd"
    r = spans_of(spark, "Redistribution and use of the forms are permitted")
    assert r["labels"] == "" and r["score"] < 0.8
    r = spans_of(spark, "İK MIT LICENSE and the Kelvin K")
    assert (r["n_base"], r["base_labels"], r["score"]) == (1, "mit", 1.0)
    assert licenses.scan_licenses(H.frame(spark).limit(0)).count() == 0


def test_native_plans_hold_no_python(spark, folder, monkeypatch):
    """Neither the results' plans nor those of the tables written on the way."""
    from tsumugi.llm import common

    plans = []

    def spy(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return common.written(df, name)

    for module in (quality, exact, mixing, licenses):
        monkeypatch.setattr(module, "written", spy)
    for f in (quality.op2_weak_quality, exact.op6_exact_dedup, mixing.op3_poisson_mix, licenses.op8_license_diagonals):
        plans.append((f.__name__, f(spark, folder)._jdf.queryExecution().executedPlan().toString()))
    assert len(plans) > 8
    for name, plan in plans:
        assert not re.search("Python|Pandas|Arrow(?!ToRow)", plan), name
