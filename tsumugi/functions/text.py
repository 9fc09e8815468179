"""Text functions as Column expressions: tokens, script tests, kana shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_SHIFTED = "".join(chr(ord(c) - 0x60) for c in _KATAKANA)
_HIRAGANA = "".join(map(chr, range(0x3040, 0x30A0)))
_RAISED = "".join(chr(ord(c) + 0x60) for c in _HIRAGANA)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits in lower case, sorted; anything else separates. Null: null."""
    split = F.split(text, "[^A-Za-z0-9]+")  # before lowering: no other letter may turn into an ASCII one
    return F.array_sort(F.array_distinct(F.transform(F.filter(split, lambda t: t != ""), ascii_lower)))


def is_hiragana(char: Column) -> Column:
    return char.rlike(r"\A[\x{3040}-\x{309F}]\z")


def is_katakana(char: Column) -> Column:
    """Half-width forms are not katakana here."""
    return char.rlike(r"\A[\x{30A0}-\x{30FF}]\z")


def is_kanji(char: Column) -> Column:
    return char.rlike(r"\A[\x{4E00}-\x{9FFF}]\z")


def is_kana_word(text: Column) -> Column:
    """All hiragana; so is the empty text."""
    return text.rlike(r"\A[\x{3040}-\x{309F}]*\z")


def is_katakana_word(text: Column) -> Column:
    """All katakana, and not empty."""
    return text.rlike(r"\A[\x{30A0}-\x{30FF}]+\z")


def is_kanji_word(text: Column) -> Column:
    """All kanji; so is the empty text."""
    return text.rlike(r"\A[\x{4E00}-\x{9FFF}]*\z")


def katakana_to_hiragana(text: Column) -> Column:
    return F.translate(text, _KATAKANA, _SHIFTED)


def hiragana_to_katakana(text: Column) -> Column:
    return F.translate(text, _HIRAGANA, _RAISED)


def has_katakana(text: Column) -> Column:
    return text.rlike(r"[\x{30A1}-\x{30F6}]")
