"""Weak supervision of text quality: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, free_names, nested, table, words_of, written


@dataclass(frozen=True)
class Rule:
    """good and bad are SQL conditions over the measures; where neither holds, the rule abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2.2 * n_words or word_chars > 13 * n_words"),
    Rule("symbols", "n_symbols * 50 <= n_words", "n_symbols * 5 > n_words"),
    Rule("symbol_runs", "n_symbol_runs * 50 <= n_words", "n_symbol_runs * 8 > n_words"),
    Rule("letters", "n_letters * 100 >= word_chars * 94", "n_letters * 100 < word_chars * 90"),
    Rule("repeated_lines", "n_dup_lines = 0 and n_lines > 1", "n_dup_lines * 2 > n_lines"),
    Rule("repeated_words", "n_repeat_words * 20 <= n_words", "n_repeat_words * 10 > n_words * 3"),
    Rule("sentences", "n_ended * 2 >= n_lines", "n_ended * 5 < n_lines"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_letters", "n_symbol_runs")


def _kept_chars(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the MEASURES as long columns named ``_q_<measure>`` (docs has no columns of such names).

    Null and empty texts measure zero throughout. All of it is built-in expressions: three-word
    windows are hashed in place, and only texts in which a hash occurs twice sort their windows, by hash and
    words, to find the positions; windows are the same if their words are.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_q_t", t).withColumn("_q_w", words_of(F.col("_q_t")))
    df = df.withColumn("_q_h", F.expr("case when size(_q_w) >= 3 then transform(slice(_q_w, 1, size(_q_w) - 2), (w, i) -> xxhash64(w, get(_q_w, i + 1), get(_q_w, i + 2))) else cast(array() as array<bigint>) end"))
    # Positions in the order of their windows' hashes; those beside an equal hash repeat, if the words are equal too.
    df = df.withColumn("_q_s", F.expr("case when size(array_distinct(_q_h)) < size(_q_h) then sort_array(transform(_q_h, (h, i) -> named_struct('h', h, 'p', i))) else cast(array() as array<struct<h:bigint,p:int>>) end"))
    words = " and ".join(f"_q_w[e.p + {i}] = _q_w[_q_s[k - 1].p + {i}]" for i in range(3))
    df = df.withColumn("_q_c", F.expr(f"size(filter(_q_s, (e, k) -> k > 0 and e.h = get(_q_s, k - 1).h and not ({words}))) > 0"))
    beside = "sort_array(transform(filter(_q_s, (e, k) -> e.h = get(_q_s, k - 1).h or e.h = get(_q_s, k + 1).h), e -> e.p))"
    window = "array(_q_w[i], _q_w[i + 1], _q_w[i + 2])"  # where hashes collide, the windows themselves are compared
    apart = f"filter(sequence(0, size(_q_h) - 1), i -> size(filter(sequence(0, size(_q_h) - 1), j -> _q_h[i] = _q_h[j] and {window} = array(_q_w[j], _q_w[j + 1], _q_w[j + 2]))) > 1)"
    df = df.withColumn("_q_p", F.expr(f"case when _q_c then {apart} else {beside} end"))
    df = df.withColumn("_q_l", F.filter(F.split("_q_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = {
        "n_words": F.size("_q_w"),
        "word_chars": _kept_chars(F.col("_q_t"), WORD_GAP),
        "n_symbols": _kept_chars(F.col("_q_t"), "[^#*$%&|<>]+"),
        "n_dup_lines": F.size("_q_l") - F.size(F.array_distinct("_q_l")),
        "n_repeat_words": F.expr("aggregate(transform(_q_p, (p, k) -> least(3, coalesce(get(_q_p, k + 1), p + 3) - p)), 0, (a, x) -> a + x)"),
        "n_lines": F.size("_q_l"),
        "n_ended": F.size(F.filter("_q_l", lambda x: x.rlike(r"[.!?:;\"')\]][\x20\x09-\x0D]*$"))),
        "n_symbol_runs": F.regexp_count("_q_t", F.lit("[#*$%&|<>]+")),
        "n_letters": _kept_chars(F.col("_q_t"), r"[^\p{L}\p{N}]+"),
    }
    return df.select(*docs.columns, *[c.cast("long").alias(f"_q_{k}") for k, c in out.items()])


def vote(rule: Rule) -> Column:
    """1 good, -1 bad, 0 abstains. A text without words abstains everywhere."""
    own = lambda cond: F.expr(_own(cond))
    return F.when(F.col("_q_n_words") == 0, 0).when(own(rule.bad), -1).when(own(rule.good), 1).otherwise(0)


def _own(cond: str) -> str:
    for m in sorted(MEASURES, key=len, reverse=True):
        cond = cond.replace(m, f"\0{MEASURES.index(m)}\0")
    for i, m in enumerate(MEASURES):
        cond = cond.replace(f"\0{i}\0", f"_q_{m}")
    return cond


#: What a rule is expected to do, before any data: P(vote) of -1, 0, 1 for good and for bad texts.
EXPECTED = ((0.02, 0.23, 0.75), (0.35, 0.25, 0.40))
#: Documents that these expectations are worth, as a share of all documents.
STRENGTH = 0.2


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good texts. good, bad: per rule P(vote | class) of votes -1, 0, 1."""

    prior: float
    good: list[tuple[float, ...]]
    bad: list[tuple[float, ...]]

    def weights(self, rule: int) -> list[float]:
        """Log odds of good for votes -1, 0, 1."""
        return [math.log(g / b) for g, b in zip(self.good[rule], self.bad[rule], strict=True)]

    def log_odds(self, votes: list[Column]) -> Column:
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, v in enumerate(votes):
            w = self.weights(k)
            out = out + F.when(v < 0, w[0]).when(v > 0, w[2]).otherwise(w[1])
        return out

    def posterior(self, votes: tuple[int, ...]) -> float:
        z = math.log(self.prior / (1 - self.prior)) + sum(self.weights(k)[v + 1] for k, v in enumerate(votes))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def accuracy(self, rule: int) -> float:
        """P(the vote is right | the rule votes)."""
        g, b, p = self.good[rule], self.bad[rule], self.prior
        return (p * g[2] + (1 - p) * b[0]) / (p * (g[0] + g[2]) + (1 - p) * (b[0] + b[2]))


def fit_votes(histogram: list[tuple[tuple[int, ...], int]], rounds: int = 300, strength: float = STRENGTH, start: float = 0.8) -> VoteModel:
    """Expectation-maximisation over vote patterns (at most 3 ** rules of them) and their counts.

    Each rule has its own P(vote | class) with abstention as a vote, since rules that only ever
    accuse are silent on good texts. EXPECTED enters as Dirichlet pseudo-counts in proportion to the
    input, so tables of any size are judged alike, and the classes can't swap. No patterns: the start values.
    """
    n = len(histogram[0][0]) if histogram else len(RULES)
    model = VoteModel(start, [EXPECTED[0]] * n, [EXPECTED[1]] * n)
    total = sum(c for _, c in histogram)
    for _ in range(rounds if total else 0):
        held = (strength * total * start, strength * total * (1 - start))
        sums = [[[held[y] * p for p in EXPECTED[y]] for y in (0, 1)] for _ in range(n)]
        mass = held[0]
        for votes, count in histogram:
            p = model.posterior(votes)
            mass += p * count
            for k, v in enumerate(votes):
                sums[k][0][v + 1] += p * count
                sums[k][1][v + 1] += (1 - p) * count
        new = VoteModel(mass / (total + sum(held)), *([tuple(x / sum(s[y]) for x in s[y]) for s in sums] for y in (0, 1)))
        model, moved = new, abs(new.prior - model.prior)
        if moved < 1e-10:
            break
    return model


def score_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, keep_text: bool = True, least_words: int = 50) -> DataFrame:
    """docs with ``_q_<measure>``, ``_q_votes`` (array of -1, 0, 1), ``_q_posterior``, ``_q_base_failed`` and ``_q_kept``.

    The texts are measured once and written to the shared folder; the vote histogram over all
    documents (at most 3 ** rules rows) goes to the driver, EM fits it, and the posterior is one
    arithmetic expression. ``_q_kept`` is posterior >= threshold and not the base rule's
    failure (under least_words words, or over half of the words in repeated three-word windows).
    Null and empty texts: all votes abstain, base failed, not kept. An empty table gives an empty
    table. Repeated rows are scored alike; long texts are measured whole. Other columns pass through, and where one has
    the name of an added column, the added one has an underscore more; keep_text=False drops the text.
    """
    names = [*(f"_q_{m}" for m in MEASURES), "_q_votes", "_q_posterior", "_q_base_failed", "_q_kept"]
    passing = docs if keep_text else docs.drop(text)
    added = free_names(passing, *names)
    df = docs.select(nested(passing), F.col(text).alias("_q_text"))
    df = measures(df, "_q_text").drop("_q_text")
    df = df.withColumn("_q_votes", F.array(*[vote(r).cast("int") for r in rules]))
    df = written(df, "quality")
    counted = df.groupBy("_q_votes").count().collect()
    model = fit_votes([(tuple(r["_q_votes"]), r["count"]) for r in counted])
    votes = [F.get("_q_votes", F.lit(i)) for i in range(len(rules))]
    failed = (F.col("_q_n_words") < least_words) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))
    df = df.withColumn("_q_posterior", 1 / (1 + F.exp(-model.log_odds(votes)))).withColumn("_q_base_failed", failed)
    df = df.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.col("_q_posterior") >= threshold))
    return df.select("_row.*", *[F.col(a).alias(b) for a, b in zip(names, added, strict=True)])


def keep_good(docs: DataFrame, text: str = "text", least_words: int = 1) -> DataFrame:
    """The documents that score_quality keeps, with the columns they came with. Short ones are judged like others, by the
    posterior; texts without words go."""
    kept = free_names(docs, "_q_kept")[0]
    return score_quality(docs, text, least_words=least_words).filter(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts by score_quality(); nulls, empty texts, repeated rows and empty tables as said there."""
    df = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = [F.col(f"_q_{m}").alias(m) for m in MEASURES[:5]]
    return df.select("doc_id", *base, F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.round("_q_posterior", 6).alias("posterior"))


def _sql() -> str:
    """The same in DuckDB SQL, for documents with distinct ids: EM is a recursive query over the vote patterns."""
    n, (good, bad) = len(RULES), EXPECTED
    votes = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in RULES)
    odds = "ln(prior / (1 - prior)) + list_sum(list_transform(range(1, {0} + 1), lambda k: ln(good[3 * k - 1 + v[k]] / bad[3 * k - 1 + v[k]])))".format(n)
    part = lambda weight, expected, held, k, j: f"({held} * {expected[j + 1]}::DOUBLE + coalesce(sum({weight} * c) FILTER (v[{k}] = {j}), 0))"
    table_ = lambda weight, expected, held: "[" + ", ".join(f"{part(weight, expected, held, k, j)} / ({' + '.join(part(weight, expected, held, k, i) for i in (-1, 0, 1))})" for k in range(1, n + 1) for j in (-1, 0, 1)) + "]"
    start = lambda e: "[" + ", ".join(f"{x}::DOUBLE" for _ in range(n) for x in e) + "]"
    return f"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
lined AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
grams AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM texts)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;"'')\\]][\\x20\\x09-\\x0D]*$'))) AS n_ended, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS n_letters,
         len(regexp_extract_all(t, '[#*$%&|<>]+')) AS n_symbol_runs
  FROM lined LEFT JOIN repeats USING (doc_id)),
voted AS MATERIALIZED (SELECT *, [{votes}] AS v FROM measured),
patterns AS MATERIALIZED (SELECT v, count(*)::DOUBLE AS c, sum(count(*)) OVER ()::DOUBLE AS n FROM voted GROUP BY v),
em AS (
  SELECT 0 AS r, 0.8::DOUBLE AS prior, {start(good)} AS good, {start(bad)} AS bad, 1::DOUBLE AS moved
  UNION ALL
  SELECT r + 1, next, new_good, new_bad, abs(next - prior) FROM (
    SELECT r, prior, (0.8 * {STRENGTH} * n + sum(q * c)) / (n + {STRENGTH} * n) AS next,
           {table_("q", good, f"{STRENGTH} * 0.8 * n")} AS new_good, {table_("(1 - q)", bad, f"{STRENGTH} * 0.2 * n")} AS new_bad
    FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS q FROM em, patterns WHERE r < 300 AND moved >= 1e-10) GROUP BY r, prior, n)),
model AS (SELECT * FROM em ORDER BY r DESC LIMIT 1),
judged AS (SELECT v AS pattern, 1 / (1 + exp(-({odds}))) AS q FROM model, patterns)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND q >= 0.5 AS kept, round(q, 6) AS posterior
FROM voted JOIN judged ON pattern = v
"""


OP2_SQL = _sql()
