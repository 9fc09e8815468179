"""Candidate dictionary forms of an inflected word, in order of discovery."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules as R

_BY_ENDING = R.by_ending()
_LONGEST = max(map(len, _BY_ENDING))
#: The seed may be anything but a bare stem that only rules can reveal.
_SEED = 0xFFFF & ~(R.TA_TE | R.DA_DE | R.IRREALIS)
_HIRAGANA = {c: c - 0x60 for c in range(ord("ァ"), ord("ン") + 1)}
_NO_PLAIN_STEM = {"Passive", "Causative", "CausativePassive"}

CANDIDATES = T.ArrayType(T.StructType().add("word", T.StringType()).add("reason_chains", T.ArrayType(T.ArrayType(T.StringType()))).add("word_type", T.IntegerType()))


@dataclass
class Candidate:
    """A form, how it was reached (each chain is a sequence of reasons) and what it may be."""

    word: str
    kind: int
    chains: list[list[str]] = field(default_factory=list)

    def reasons(self) -> set[str]:
        return {r for chain in self.chains for r in chain}

    def extended(self, reasons: tuple[str, ...]) -> list[list[str]]:
        """The chains once a rule with these reasons has been undone as well."""
        if not reasons:
            return [list(c) for c in self.chains]
        if not self.chains:
            return [list(reasons)]
        first, rest = self.chains[0], [list(c) for c in self.chains[1:]]
        if reasons[0] == "Causative" and first[:1] == ["PotentialOrPassive"]:
            first = ["CausativePassive", *first[1:]]
        elif not (reasons[0] == "MasuStem" and first):
            first = [*reasons, *first]
        return [list(first), *rest]

    def ichidan(self) -> "Candidate | None":
        """The ichidan verb whose stem this may be."""
        if not self.kind & (R.MASU | R.TA_TE | R.IRREALIS):
            return None
        if self.kind & R.IRREALIS and self.chains and self.chains[0][:1] and self.chains[0][0] in _NO_PLAIN_STEM:
            return None
        bare = self.kind & R.MASU and not self.chains
        return Candidate(self.word + "る", R.ICHIDAN | R.KURU, [list(c) for c in self.chains] + [["MasuStem"]] * bool(bare))


def deinflect_word(word: str) -> list[Candidate]:
    """All forms the rules lead to, the word itself first; forms that can only be stems are left out.

    No reason occurs twice along a way, so the search ends. A form found again with the same type adds
    a chain to its latest candidate; with another type it is a candidate of its own.
    """
    found = [Candidate(word, _SEED)]
    latest = {word: found[0]}
    for at in found:  # grows as it goes
        if at.kind & R.ICHIDAN and at.chains == [["MasuStem"]]:
            continue
        if (verb := at.ichidan()) is not None:
            found.append(verb)  # not in latest: later rules do not add to it
        used = at.reasons()
        for size in range(min(_LONGEST, len(at.word)), 0, -1):
            for rule in _BY_ENDING.get(at.word[-size:].translate(_HIRAGANA), ()):
                form = at.word[:-size] + rule.replacement
                if not at.kind & rule.from_type or not form or used.intersection(rule.reasons):
                    continue
                known = latest.get(form)
                if known is not None and known.kind == rule.to_type:
                    if rule.reasons:
                        known.chains.insert(0, list(rule.reasons))
                    continue
                new = Candidate(form, rule.to_type, at.extended(rule.reasons))
                latest[form] = new
                found.append(new)
    return [c for c in found if c.kind & R.ANY]


@F.pandas_udf(CANDIDATES)
def _deinflect(words: pd.Series) -> pd.Series:
    return words.map(lambda w: [{"word": c.word, "reason_chains": c.chains, "word_type": c.kind} for c in deinflect_word(w)], na_action="ignore")


def deinflect(word: Column) -> Column:
    """CANDIDATES of a word; null for null. The position in the array is the order of discovery."""
    return _deinflect(word)
