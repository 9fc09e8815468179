import random

import pytest

from tsumugi.operators import candidates as C


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(keys, terms, score):
    out = []
    for pos, term in terms:
        best = {}
        for rank, key, seq in sorted(keys):
            s = score(key, term)
            if s is not None and (seq not in best or best[seq][0] < s):
                best[seq] = (s, key)
        out += [(pos, k, seq, key, s) for k, (seq, (s, key)) in enumerate(sorted(best.items(), key=lambda x: (-x[1][0], x[0])))]
    return sorted(out)


def fuzzy_score(d):
    def score(key, term):
        if key == term:
            return 1.0
        if distance(key, term) > d:
            return None
        a, b = float(max(1, len(key))), float(max(1, len(term)))
        return max(0.1, 0.5 - abs(a - b) / (a + b) * 0.2)

    return score


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abねネ") for _ in range(rng.randint(0, n)))
    keys = sorted({(rng.randrange(3), word(7), rng.randrange(40)) for _ in range(160)})
    terms = list(enumerate([word(6) for _ in range(12)] + ["", "ab", "ab"]))
    frame = spark.createDataFrame([(r, str(r), k, len(k), s) for r, k, s in keys], "script_rank int, script string, key string, key_len int, seq_id bigint")
    return keys, terms, frame, spark.createDataFrame(terms, "pos bigint, term string")


@pytest.mark.parametrize("d", range(5))
def test_fuzzy_is_whole(data, d):
    keys, terms, k, t = data
    got = sorted((r["pos"], r["ord"], r["seq_id"], r["match_key"], r["score"]) for r in C.fuzzy(t, k, d).collect())
    assert got == brute(keys, terms, fuzzy_score(d))


def test_prefix_is_whole(data):
    keys, terms, k, t = data
    got = sorted((r["pos"], r["ord"], r["seq_id"], r["match_key"], r["score"]) for r in C.prefix(t, k).collect())
    assert got == brute(keys, terms, lambda key, term: 1.0 if key == term else 0.5 if key.startswith(term) else None)


def test_no_nested_loops(data):
    _, _, k, t = data
    for df in (C.fuzzy(t, k, 2), C.prefix(t, k), C.exact(t, k), C.deinflected(t, k)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(data):
    _, _, k, t = data
    for df in (C.fuzzy(t.limit(0), k, 2), C.prefix(t.limit(0), k), C.exact(t, k.limit(0)), C.deinflected(t, k.limit(0))):
        assert df.count() == 0


def test_fuzzy_sends_no_probes_through_the_driver(spark, tmp_path):
    """A term makes many probes, which the size of its file doesn't show; a batch of few distinct terms asks for each once."""
    spark.range(20_000).selectExpr("id AS pos", "concat('some word ', id % 7) AS term").write.parquet(str(tmp_path / "terms"))
    terms = spark.read.parquet(str(tmp_path / "terms"))
    keys = spark.createDataFrame([(0, "kana", f"some word {i}{i % 2}", 11, i) for i in range(9)], "script_rank int, script string, key string, key_len int, seq_id bigint")
    pairs = C.fuzzy_pairs(terms, keys, 1)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    want = {(i, k) for i in range(7) for k in range(9) if distance(f"some word {i}", f"some word {k}{k % 2}") <= 1}
    got = pairs.groupBy("term", "seq_id").count().collect()
    assert {(int(r["term"][-1]), r["seq_id"]) for r in got} == want
    assert sum(r["count"] for r in got) == sum(len(range(i, 20_000, 7)) for i, _ in want)
