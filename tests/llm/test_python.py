"""Language, toxicity, SimHash, token counts, packing, LM scoring."""

import math
import random
import zlib
from collections import Counter

import helpers as H
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tsumugi.llm import brown, components, crf, near, packing, simhash, tokens, toxicity


def key(x):
    return tuple((v is None, v) for v in x)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    data = H.rows()
    labels = []
    for k in range(200):
        bad = k % 2
        data.append((1000 + k, H.prose(rng, "en", rng.randint(30, 90), insult=3 * bad), "en", "a", 1, True, "", "", ""))
        labels.append((1000 + k, 1, bad))
    return H.write_tables(spark, tmp_path_factory.mktemp("python"), data, labels)


# Language


def brute_crf(emission, first, transition, start):
    """Posteriors by summing over all label sequences, one sequence at a time."""
    n, labels = emission.shape
    out = np.zeros_like(emission)
    bounds = [*np.nonzero(first)[0].tolist(), n]
    for a, b in zip(bounds, bounds[1:], strict=False):
        total = 0.0
        for path in np.ndindex(*[labels] * (b - a)):
            s = start[path[0]] + emission[a, path[0]] + sum(transition[p, q] + emission[a + i + 1, q] for i, (p, q) in enumerate(zip(path, path[1:], strict=False)))
            w = math.exp(s)
            total += w
            for i, p in enumerate(path):
                out[a + i, p] += w
        out[a:b] /= total
    return out


def test_forward_backward(monkeypatch):
    monkeypatch.setattr(crf, "BLOCK", 4)
    rng = np.random.default_rng(2)
    e, t, s = rng.normal(size=(17, 3)) * 2, rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.zeros(17, bool)
    first[[0, 6, 7, 13]] = True
    gamma, moved = crf.forward_backward(e, first, t, s)
    assert np.allclose(gamma, brute_crf(e, first, t, s))
    assert moved.sum() == pytest.approx(13)


def test_gradient_is_that_of_the_likelihood(monkeypatch):
    """Expected transitions are the derivative of the log partition function."""
    monkeypatch.setattr(crf, "BLOCK", 4)
    rng = np.random.default_rng(3)
    e, t, s = rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    first = np.array([True, False, False, False, False])

    def log_z(t):
        return math.log(sum(math.exp(s[p[0]] + e[0, p[0]] + sum(t[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:], strict=False)))) for p in np.ndindex(2, 2, 2, 2, 2)))

    _, moved = crf.forward_backward(e, first, t, s)
    for i in range(2):
        for j in range(2):
            d = np.zeros((2, 2))
            d[i, j] = 1e-5
            assert moved[i, j] == pytest.approx((log_z(t + d) - log_z(t - d)) / 2e-5, abs=1e-6)


def test_language_query(spark, folder):
    rows = crf.op1_crf_language(spark, folder).collect()
    assert len(rows) == len(H.rows()) + 200
    for r in rows:
        assert r["held_out"] == (H.remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in rows}
    truth = {d: lang for d, t, lang, *_ in H.rows() if d is not None and d < 60}
    held = [d for d in truth if by[d]["held_out"]]
    assert held and all(by[d]["lang_pred"] == truth[d] for d in held)
    for d, t, *_ in H.rows():
        if d is not None and not any(map(str.isalpha, t or "")):
            assert (by[d]["lang_pred"], by[d]["score"]) == ("und", 0.0)


def test_code_switching(spark):
    rng = random.Random(4)
    texts = [(crf.words_in(H.prose(rng, lang, 80)), lang) for lang in ("en", "de", "fr") for _ in range(20)]
    model = crf.train(texts)
    mixed = [(w, lang) for lang in ("de", "en", "fr") for w in crf.words_in(H.prose(rng, lang, 30))]
    p = model.word_posteriors([[w for w, _ in mixed], [], ["the"]])
    right = np.mean([model.labels[int(np.argmax(q))] == lang for q, (_, lang) in zip(p[0], mixed, strict=True)])
    assert right > 0.93 and p[1].shape == (0, 3) and p[2].shape == (1, 3)
    assert np.all(np.diag(model.transition) > model.transition.max(1) - 1e-9)
    df = crf.label_languages(H.frame(spark).select("doc_id", "text", "label"), model, with_words=True)
    assert df.columns == ["doc_id", "label", "_lang", "_score", "_words"] and df.count() == len(H.rows())
    assert crf.label_languages(H.frame(spark).limit(0), model).count() == 0
    none = crf.label_languages(H.frame(spark).select("doc_id", "text"), crf.train([]))
    assert {r["_lang"] for r in none.collect()} == {"und"}


# Toxicity


def test_toxicity_query(spark, folder):
    rows = {r["doc_id"]: r for r in toxicity.op4_lexicon_toxicity(spark, folder).collect()}
    assert len([k for k in rows if k is not None]) >= 270
    for d, r in rows.items():
        assert r["held_out"] == (H.remainder(d, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [k for k in range(200) if rows[1000 + k]["held_out"]]
    assert held and all(rows[1000 + k]["predicted"] == k % 2 for k in held)


def test_folding_and_exceptions():
    assert toxicity.fold("ІDІ0T m0r0n $cum") == toxicity.fold("idiot moron scum") == " idiot moron scum "
    assert toxicity.fold("1oser") == toxicity.fold("Loser") and toxicity.fold(None) == "  "
    lex = toxicity.Lexicon({" trash ": 2.0, " idiot": 3.0, " idiotic ": 1.0}, ("trash can",))
    a = lex.automaton()
    assert toxicity.hits(toxicity.fold("trash can, trash"), a) == (2.0, 1)
    assert toxicity.hits(toxicity.fold("idiotic trash!"), a) == (5.0, 2)
    assert toxicity.hits(toxicity.fold("notrash midiot"), a) == (0, 0)
    assert toxicity.hits(toxicity.fold("trash"), toxicity.Lexicon({}, ()).automaton()) == (0, 0)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_hits_against_every_word(text):
    lex = {" ab ": 1.5, " abc": 2.0, " abc ": 4.0, " b ": 1.0}
    folded = toxicity.fold(text + " ab abcd b")
    want = [max([w for p, w in lex.items() if f" {x} ".startswith(p)], default=0) for x in folded.split()]
    assert toxicity.hits(folded, toxicity.Lexicon(lex, ()).automaton()) == (pytest.approx(sum(want)), sum(w > 0 for w in want))


def test_toxicity_without_labels(spark):
    df = H.frame(spark)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    lex = toxicity.learn(df, none, "text", "doc_id", "toxic", ())
    assert {r["_hits"] for r in toxicity.score_toxicity(df, lex).collect()} == {0}
    assert toxicity.score_toxicity(df.limit(0), lex).count() == 0


# SimHash


def brute_fingerprint(text):
    import xxhash

    w = H.words(H.lower(text))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_covering():
    from itertools import combinations

    triples = simhash.covering_triples()
    assert len(set(triples)) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def simhash_expected(data):
    fps = [brute_fingerprint(t) for _, t, *_ in data]
    roots = brute_components(fps)
    least = {}
    for (d, *_), r in zip(data, roots, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{f:016x}", least.get(r)) for (d, *_), f, r in zip(data, fps, roots, strict=True)]


@pytest.mark.parametrize("dense", [24, 1])
def test_simhash(spark, folder, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    got = [(r["_id"], f"{r['_fp'] % 2**64:016x}", r["_component"]) for r in simhash.near_groups(H.frame(spark)).collect()]
    assert sorted(got, key=key) == sorted(simhash_expected(H.rows()), key=key)
    assert {c for d, _, c in got if d is not None and 60 <= d < 66} == {0}  # copies of the first text


@pytest.mark.parametrize("dense", [24, 2])
def test_links_of_random_fingerprints(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(8)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    labels = {r["_node"]: r["_label"] for r in components.component_labels(simhash.near_links(spark.createDataFrame([(f,) for f in signed], "_fp bigint"))).collect()}
    want = brute_components(fps)
    pairs = {(labels.get(s, s), w) for s, w in zip(signed, want, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len(set(want))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 300), (300, 200), (7, 7), (500, 501), (501, 500)]
    got = {r["_node"]: r["_label"] for r in components.component_labels(spark.createDataFrame(links, "_a bigint, _b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100, 500: 500, 501: 500}
    assert components.component_labels(spark.createDataFrame([], "_a bigint, _b bigint")).count() == 0


def jaccard_groups(data, similarity=0.8, shingle=5):
    """(id, text) kept by brute force: all pairs of texts, all shingles."""
    sets = {}
    for d, t, *_ in data:
        w = H.words(H.lower(t))
        sets.setdefault(t or "", {" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    texts = list(sets)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if not every or both >= similarity * every:
                root[find(a)] = find(b)
    return {t: find(t) for t in texts}


@pytest.mark.parametrize("dense", [24, 1])
def test_drop_similar(spark, monkeypatch, dense):
    monkeypatch.setattr(near, "DENSE", dense)
    monkeypatch.setattr(near, "BLOCK", 5)
    rng = random.Random(5)
    data = H.rows()
    for k in range(12):  # near copies with one to four words changed, of texts of 100 words and more
        base = [t for d, t, *_ in data if d is not None and d < 60 and len(H.words(t)) >= 100][k]
        for n in (1, 2, 3, 4):
            w = base.split(" ")
            for i in rng.sample(range(len(w)), n):
                w[i] = f"other{k}x{i}"
            data.append((2000 + 10 * k + n, " ".join(w), "en", "a", 1, True, "", "", ""))
    groups = jaccard_groups(data)
    df = H.frame(spark, data)
    left = near.drop_similar(df)
    assert left.columns == df.columns
    rows = left.collect()
    kept = Counter(groups[r["text"] or ""] for r in rows)
    found = sum(n == 1 for n in kept.values()) / len(kept)
    assert set(kept) == set(groups.values())  # no group is lost
    assert found >= 0.97, [n for n in kept.values() if n > 1]  # and few of its near copies stay
    best = {}
    for d, t, *_ in data:
        g = groups[t or ""]
        best[g] = min(best.get(g, (True, 0)), (d is None, d or 0))
    assert all(any((r["doc_id"] is None, r["doc_id"] or 0) == best[g] for r in rows if groups[r["text"] or ""] == g) for g in kept)
    assert near.drop_similar(df.limit(0)).count() == 0


@pytest.mark.parametrize(("dense", "block"), [(24, 100_000), (2, 100_000), (24, 70)])
def test_wide_index_grows_with_its_nodes(spark, monkeypatch, dense, block):
    """A large group of near copies makes a few links a node, which join what all its pairs would; then all pairs across components."""
    monkeypatch.setattr(near, "DENSE", dense)
    monkeypatch.setattr(near, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 32, np.uint8)
    of_base = np.where(rng.random((90, 256)) < 0.04, 1, 0).astype(np.uint8)
    lanes = np.concatenate([np.packbits(np.unpackbits(base) ^ of_base, axis=1).view(np.uint64), rng.integers(0, 2**63, (20, 4), np.uint64)])
    rows = [(k, *map(int, x.view(np.int64))) for k, x in enumerate(lanes)]
    nodes = spark.createDataFrame(rows, "_node bigint, _w0 bigint, _w1 bigint, _w2 bigint, _w3 bigint")
    assert block < len(rows) or near.index_groups(nodes, len(rows)).count() == 24 * len(rows)
    want = set()
    for a in range(len(rows)):
        same = (lanes ^ lanes[a]).view(np.uint8).reshape(-1, 4, 8) == 0
        ok = (same.sum(2).max(1) >= 3) & (same.sum((1, 2)) >= near.SHARED) & (np.bitwise_count(lanes ^ lanes[a]).sum(1, dtype=int) <= near.BITS)
        want |= {(a, b) for b in np.nonzero(ok)[0].tolist() if b > a}
    links = near.in_groups(nodes, len(rows)).collect()
    assert {(r["_a"], r["_b"]) for r in links} <= want and (block < len(rows) or len(links) < 24 * 90 < len(want))
    label = lambda pairs: {r["_node"]: r["_label"] for r in components.component_labels(spark.createDataFrame(list(pairs), "_a bigint, _b bigint")).collect()}
    assert label((r["_a"], r["_b"]) for r in links) == label(want)
    across = near.in_groups(nodes.selectExpr("*", "_node % 3 AS _of"), len(rows)).collect()
    assert {(r["_a"], r["_b"]) for r in across} == {(a, b) for a, b in want if a % 3 != b % 3}
    assert len(across) == len({(r["_a"], r["_b"]) for r in across})


def changed_copies(n, changes, seed):
    """Texts of 150 words, all of one text with so many words changed, and a few others."""
    rng = random.Random(seed)
    base, out = [f"w{rng.randrange(400)}" for _ in range(150)], []
    for k in range(n):
        w = list(base)
        for i in rng.sample(range(150), rng.choice(changes)):
            w[i] = f"own{k}x{i}"
        out.append(" ".join(w))
    return out + [" ".join(f"v{rng.randrange(400)}" for _ in range(150)) for _ in range(20)]


def test_near_pairs_below_the_similarity_make_no_rows(spark, monkeypatch):
    """Candidates across the components of a large group grow with its square; the tables made on the way do not."""
    made, into = [], near.written
    monkeypatch.setattr(near, "written", lambda df, name: made.append((into(df, name), name)) or made[-1][0])
    data = [(k, t, "en", "a", 1, True, "", "", "") for k, t in enumerate(changed_copies(300, [3], 8))]
    left = near.drop_similar(H.frame(spark, data)).count()
    groups = set(jaccard_groups(data).values())
    assert len(groups) <= left <= 1.1 * len(groups)  # the similarity is exact, so only what the index misses stays besides
    again = next(df for df, name in made if name == "again")
    assert near.in_groups(again, again.count()).count() > 24 * len(data)
    assert {name for df, name in made if df.count() > 24 * len(data)} == set()


@pytest.mark.parametrize(("dense", "block", "hashes"), [(24, 100_000, 2_000_000), (2, 100_000, 5_000), (24, 70, 5_000)])
def test_crossing_links_join_what_all_pairs_would(spark, monkeypatch, dense, block, hashes):
    monkeypatch.setattr(near, "DENSE", dense)
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "HASHES", hashes)
    texts = [*changed_copies(110, [1, 2, 3], 9), "", " \n"]
    hashed = [near.shingle_set(t, 5).view(np.int64).tolist() for t in texts]
    rows = [(k, *near.wide_fingerprint(np.array(s, np.int64).view(np.uint64)).tolist(), k % 7 if k < 60 else k, s) for k, s in enumerate(hashed)]
    df = spark.createDataFrame(rows, "_node bigint, _w0 bigint, _w1 bigint, _w2 bigint, _w3 bigint, _of bigint, _set array<bigint>")
    nodes, sets = df.drop("_set"), df.select("_node", "_set")
    similar = lambda a, b: len({*hashed[a]} & {*hashed[b]}) >= 0.8 * len({*hashed[a]} | {*hashed[b]})
    want = {(r["_a"], r["_b"]) for r in near.in_groups(nodes, len(rows)).collect() if similar(r["_a"], r["_b"])}
    got = {tuple(sorted((r["_a"], r["_b"]))) for r in near.crossing_links(nodes, len(rows), sets, 0.8).collect()}
    assert (len(texts) - 2, len(texts) - 1) in want and got <= want
    of = {r[0]: 1000 + r[5] for r in rows}
    label = lambda pairs: {r["_node"]: r["_label"] for r in components.component_labels(spark.createDataFrame([*pairs, *of.items()], "_a bigint, _b bigint")).collect()}
    assert label(got) == label(want)
    found = near.crossing_nodes(nodes, len(rows)).collect()
    assert len(found) == len({(r["_g"], r["_node"]) for r in found}) <= 24 * len(rows)


def test_ids_that_repeat_across_groups(spark):
    a, b = "the of and to in is that for it was on are with as his they", "der die und in den von zu das mit sich des auf ist im dem nicht"
    one = lambda d, t: (d, t, "en", "a", 1, True, "", "", "")
    data = [one(5, a), one(2, b), one(5, b), one(None, b), one(7, None), one(3, ""), one(9, "x y"), one(9, "x y")]
    left = sorted((r["doc_id"], r["text"]) for r in near.drop_similar(H.frame(spark, data)).collect())
    assert left == [(2, b), (3, ""), (5, a), (9, "x y")]


def test_wide_tally(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-(2**63), 2**63, (200, 4))
    b = a ^ (rng.integers(0, 256, (200, 4)) << (8 * rng.integers(0, 8, (200, 4)))) * (rng.random((200, 4)) < 0.7)
    df = spark.createDataFrame([tuple(map(int, [*x, *y])) for x, y in zip(a, b, strict=True)], "a0 long, a1 long, a2 long, a3 long, b0 long, b1 long, b2 long, b3 long")
    from pyspark.sql import functions as F

    df = df.select(*[F.struct(*[F.col(f"{s}{i}").alias(near.WORDS[i]) for i in range(4)]).alias(s) for s in "ab"])
    got = df.select(near.shared_bytes("a", "b"), near.differing_bits("a", "b")).collect()
    x = a ^ b
    want = list(zip((np.ascontiguousarray(x).view(np.uint8).reshape(200, 32) == 0).sum(1).tolist(), np.bitwise_count(x.view(np.uint64)).sum(1).tolist(), strict=True))
    assert [tuple(r) for r in got] == want


def test_count_filter_prunes(spark):
    """A pair that meets under a triple with only three shared bytes is not retained."""
    base = 0x0102030405060708
    three, four = base ^ 0x1111111111000000, base ^ 0x1111111100000000
    df = spark.createDataFrame([(1, base), (1, three), (1, four)], "_key long, _fp long")
    kept = {(r["_a"], r["_b"]) for r in simhash.tallied(df, 4).collect()}
    assert kept == {tuple(sorted((base, four))), tuple(sorted((three, four)))}


# Tokens and packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=97, max_codepoint=0x260), min_size=1, max_size=14), max_size=8))
def test_plain_words_give_the_librarys_ids(words):
    library, text = Tokenizer.from_file(WORD), " ".join(words)
    (data,) = tokens.encoded([text], WORD)
    assert np.frombuffer(data, np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" .,;:!?$%&*#\n\t'sİΣß<|endoftext|>́ 　"), st.characters(codec="utf-8")), max_size=60), max_size=4))
def test_pieces_give_the_librarys_ids(path, texts):
    library = Tokenizer.from_file(path)
    texts = texts + ["it's <|endoftext|> here", "a  b", " a", "x <|endoftext|>", "A B\nC d", "a word., B. É! <|ENDOFTEXT|> x<|endoftext|>. 1. ². ª, İI. Σ; ΑΣ, it's, don'T."]
    for text, data in zip(texts, tokens.encoded(texts, path), strict=True):
        assert np.frombuffer(data, np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_cache(spark, folder, tmp_path):
    library = Tokenizer.from_file(BYTE)
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, *_ in H.rows()]
    got = [tuple(r) for r in tokens.op7_token_cache(spark, folder).collect()]
    assert [x for x in sorted(got, key=key) if x[0] is None or x[0] < 1000] == sorted(want, key=key)
    cache = str(tmp_path / "cache")
    df = H.frame(spark)
    half = df.filter("doc_id < 30")
    tokens.count_tokens(half, BYTE, cache).count()
    first = tokens.read_cache(spark, cache).count()
    assert first == len({t for d, t, *_ in H.rows() if d is not None and d < 30})
    out = tokens.count_tokens(df, BYTE, cache)
    assert sorted(((r["doc_id"], r["_tokens"]) for r in out.collect()), key=key) == sorted(((d, n) for d, _, n, _ in want), key=key)
    assert "text" not in out.columns and "label" in out.columns
    assert tokens.read_cache(spark, cache).count() == len({t or "" for _, t, *_ in H.rows()})
    tokens.count_tokens(df, BYTE, cache).count()  # nothing is missing now
    assert tokens.read_cache(spark, cache).count() == len({t or "" for _, t, *_ in H.rows()})
    tokens.count_tokens(half, WORD, cache).count()  # another tokenizer has entries of its own
    assert tokens.read_cache(spark, cache).select("tokenizer").distinct().count() == 2
    assert tokens.count_tokens(df.limit(0), BYTE, str(tmp_path / "none")).count() == 0


def check_packing(rows, limit):
    at = {}
    for sequence, offset, length in sorted(rows):
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length
    assert max(at.values(), default=0) <= limit
    return len(at)


def test_packing(spark):
    library = Tokenizer.from_file(WORD)
    want = []
    for d, t, *_ in H.rows():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        want += [(d, k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    out = packing.pack(H.frame(spark), WORD, limit=256, with_ids=True).collect()
    assert sorted(((r["_id"], r["_piece"], r["_start"], r["_length"], r["_crc"]) for r in out), key=key) == sorted(want, key=key)
    assert all(zlib.crc32(np.array(r["_ids"], np.uint32).tobytes()) == r["_crc"] for r in out)
    n = check_packing([(r["_sequence"], r["_offset"], r["_length"]) for r in out], 256)
    spaces = []
    for a in sorted((x[3] for x in want), reverse=True):  # plain best-fit decreasing
        fit = min((s for s in spaces if s >= a), default=None)
        if fit is not None:
            spaces.remove(fit)
        spaces.append((256 if fit is None else fit) - a)
    assert math.ceil(sum(x[3] for x in want) / 256) <= n <= len(spaces) + 1
    assert packing.pack(H.frame(spark).limit(0), WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_histogram_packing(histogram):
    plans = packing.pack_histogram(histogram, 64)
    used = Counter()
    for contents, n in plans:
        assert n > 0 and 0 < sum(contents) <= 64
        for a in contents:
            used[a] += n
    assert used == Counter(histogram)
    rows = packing.slots(plans)
    for a, n in histogram.items():
        own = sorted((lo, lo + m) for x, lo, m, *_ in rows if x == a)
        assert own[0][0] == 0 and own[-1][1] == n and all(p[1] == q[0] for p, q in zip(own, own[1:], strict=False))


def test_ranks_of_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    rows = [(k % 5, k, k) for k in range(60)] + [(1, 1, 1)] * 3
    df = spark.createDataFrame([(a, b, c, 8 if b % 3 else 9, k) for k, (a, b, c) in enumerate(rows)], "_id bigint, _piece int, _crc bigint, _length bigint, _serial bigint")
    got = Counter((r["_length"], r["_rank"]) for r in packing.ranked(df).collect())
    n = Counter(8 if b % 3 else 9 for _, b, _ in rows)
    assert got == Counter((a, k) for a, m in n.items() for k in range(m))


def test_copies_lie_apart(spark):
    """Twenty documents of one length, three copies each: no sequence has two copies of one."""
    words = "the of and to in is that for it was".split()
    data = [(k, " ".join(words[(k + j) % 10] for j in range(40)), "en", "a", 1, True, "", "", "") for k in range(20) for _ in range(3)]
    out = packing.pack(H.frame(spark, data), WORD, limit=2 * 41).collect()
    met = Counter((r["_sequence"], r["_id"]) for r in out)
    assert len(out) == 60 and len({r["_sequence"] for r in out}) == 30 and max(met.values()) == 1


def test_racing_appends_keep_both(spark, tmp_path):
    """Each run appends files of its own, so neither run's commit removes the other's."""
    from concurrent.futures import ThreadPoolExecutor

    cache, df = str(tmp_path / "cache"), H.frame(spark)
    halves = [df.filter("doc_id < 30"), df.filter("doc_id >= 30")]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda x: tokens.count_tokens(x, BYTE, cache).count(), halves))
    want = {t or "" for d, t, *_ in H.rows() if d is not None}
    assert tokens.read_cache(spark, cache).select("digest").distinct().count() == len(want)


# LM scoring


def test_brown_base(spark, folder):
    data = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    split = lambda t: [*H.words(H.lower(t)), ""]
    c = Counter(w for d, t in data if H.remainder(d, 10) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = [(d, H.remainder(d, 10) == 0, len(w := split(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for d, t in data]
    rows = brown.op10_brown_bigrams(spark, folder).collect()
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in rows)


def test_rare_words_score_as_local_ones(spark):
    """Words that go through the join get the same sums as broadcast words."""
    from pyspark.sql import functions as F

    df = H.frame(spark).withColumn("held", F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False)))
    runs = []
    for local in (100_000, 60):
        rows = brown.score_texts(df, "held", size=brown.Size(clustered=20, endings=16, classes=4, local=local)).collect()
        runs.append(sorted(((r["doc_id"], round(r["base_score"], 6), r["n_known"], round(r["score"], 6)) for r in rows), key=key))
    assert runs[0] == runs[1]


def likelihood(left, right, n, cls, k):
    t = np.zeros((k, k))
    np.add.at(t, (cls[left], cls[right]), n)
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0)
    return f(t).sum() - f(t.sum(0)).sum() - f(t.sum(1)).sum()


def test_exchange_reaches_a_local_optimum():
    rng = np.random.default_rng(5)
    group = np.arange(24) % 3
    left = rng.integers(0, 24, 4000)
    right = np.array([rng.choice(np.nonzero(group == (group[a] + 1) % 3)[0]) if rng.random() < 0.9 else rng.integers(0, 24) for a in left])
    pairs, n = np.unique(np.stack([left, right]), axis=1, return_counts=True)
    order = rng.permutation(24)  # so that the start is not the answer
    l, r, n = order[pairs[0]], order[pairs[1]], n.astype(float)
    cls = brown.exchange_clusters(l, r, n, 24, 3, rounds=50)
    best = likelihood(l, r, n, cls, 3)
    for u in range(24):
        for c in range(3):
            moved = cls.copy()
            moved[u] = c
            assert likelihood(l, r, n, moved, 3) <= best + 1e-6


def test_exchange_of_many_words_moves_each_to_its_best_class():
    """Against the likelihood, recounted for every word and class."""
    rng = np.random.default_rng(6)
    text = rng.integers(0, 30, 700) * rng.integers(0, 2, 700)  # many followed by themselves
    before, n = np.roll(text, 1), np.ones(len(text))
    cls = rng.integers(0, 4, 30)
    table = np.zeros((4, 4))
    np.add.at(table, (cls[before], cls[text]), 1)
    cells = Counter()
    for a, b in zip(before.tolist(), text.tolist(), strict=True):
        if a == b:
            cells[a, 8] += 1
        else:
            cells[a, int(cls[b])] += 1
            cells[b, 4 + int(cls[a])] += 1
    row, code = np.array(sorted(cells)).T
    got = brown.exchange_all(table, cls, row, code, np.array([float(cells[k]) for k in sorted(cells)]))
    for w in range(30):
        gains = []
        for c in range(4):
            moved = cls.copy()
            moved[w] = c
            gains.append(likelihood(before, text, n, moved, 4))
        assert gains[got[w]] == pytest.approx(max(gains), abs=1e-6)
    assert (got != cls).any()


@pytest.mark.parametrize("local", [100_000, 5])
def test_words_outside_the_core_get_classes_of_their_own(spark, local):
    """Two kinds of words alternate; but for one of each they are too rare for the core, and have the same ending: only their classes tell the order."""
    rng = random.Random(7)
    one, two = ["p"] * 15 + [f"a{k}xyz" for k in range(15)], ["q"] * 15 + [f"b{k}xyz" for k in range(15)]
    texts = [" ".join(w for _ in range(10) for w in ("go", rng.choice(one), rng.choice(two), "on")) for _ in range(60)]
    data = [(k, t, False) for k, t in enumerate(texts)] + [(100, "go a1xyz b1xyz on", True), (101, "go b1xyz a1xyz on", True)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, held boolean")
    rows = brown.score_texts(df, "held", size=brown.Size(clustered=5, endings=4, classes=6, local=local)).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[100] > score[101] + 1


def test_brown_edge_tables(spark):
    from pyspark.sql import functions as F

    df = H.frame(spark)
    assert brown.score_texts(df.limit(0).withColumn("held", F.lit(False)), "held").count() == 0
    all_held = brown.score_texts(df.withColumn("held", F.lit(True)), "held").collect()
    assert len(all_held) == len(H.rows()) and {r["train_tokens"] for r in all_held} == {0}
