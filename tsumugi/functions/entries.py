"""Accessors of an entry's columns (kanji, kana, sense) as Column expressions. All are null-safe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def primary_kanji(kanji: str = "kanji") -> Column:
    return F.get(kanji, F.lit(0))["text"]


def primary_kana(kana: str = "kana") -> Column:
    return F.get(kana, F.lit(0))["text"]


def headword(kanji: str = "kanji", kana: str = "kana") -> Column:
    return F.coalesce(primary_kanji(kanji), primary_kana(kana))


def is_common(kanji: str = "kanji", kana: str = "kana") -> Column:
    some = lambda c: F.coalesce(F.exists(c, lambda x: x["common"]), F.lit(False))
    return some(kanji) | some(kana)


def glosses(language: str, sense: str = "sense") -> Column:
    """Texts of the language's glosses through all senses, in order."""
    every = F.flatten(F.transform(sense, lambda s: s["gloss"]))
    return F.transform(F.filter(every, lambda g: g["lang"] == language), lambda g: g["text"])


def parts_of_speech(sense: str = "sense") -> Column:
    """Distinct, as first seen."""
    return F.array_distinct(F.flatten(F.transform(sense, lambda s: s["partOfSpeech"])))


def first_gloss(sense: str = "sense") -> Column:
    return F.get(F.get(sense, F.lit(0))["gloss"], F.lit(0))["text"]
