import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tsumugi.functions import rules
from tsumugi.functions.deinflect import deinflect_word
from tsumugi.functions.kana import romaji_key_text, to_hiragana_text, to_katakana_text, to_romaji_text
from tsumugi.plans.queries import DEINFLECTIONS


@pytest.mark.parametrize("inflected, base, kind, reasons", DEINFLECTIONS)
def test_forms(inflected, base, kind, reasons):
    first = next(c for c in deinflect_word(inflected) if c.word == base and c.kind == kind)
    assert "/".join("+".join(c) for c in first.chains) == reasons


@pytest.mark.parametrize("inflected, base", [("見ていている", "見る"), ("見させさせる", "見る"), ("見とけとく", "見る"), ("もどって", "もどく"), ("美しいです", "美しい")])
def test_forms_not_reached(inflected, base):
    assert not any(c.word == base and c.kind & (rules.ICHIDAN | rules.GODAN | rules.IADJ) for c in deinflect_word(inflected))


@pytest.mark.parametrize(
    "inflected, base",
    [("請うた", "請う"), ("のたもうた", "のたもう"), ("いらっしゃいます", "いらっしゃる"), ("くださいます", "くださる"), ("ございます", "ござる"), ("食べている", "食べる"), ("食べておる", "食べる"), ("読んでいる", "読む"), ("書かざるを得ない", "書く"), ("書かざるえぬ", "書く"), ("食べないで", "食べる"), ("し得る", "する"), ("高すぎる", "高い"), ("お読みになる", "お読む"), ("食べちゃう", "食べる"), ("読んじゃう", "読む")],
)
def test_families(inflected, base):
    assert any(c.word == base for c in deinflect_word(inflected))


def test_rule_table():
    table = rules.all_rules()
    assert len(table) == len(set(table)) == 241
    assert [sum(len(r.ending) == n for r in table) for n in range(1, 8)] == [56, 90, 50, 23, 6, 12, 4]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="たべらるさせないでいくっんきしすタベあ漢aé ", max_size=12))
def test_any_word_ends_and_comes_first(word):
    out = deinflect_word(word)
    assert out[0].word == word and out[0].chains == []
    for c in out:
        assert c.kind & rules.ANY
        for chain in c.chains:
            assert len(chain) == len(set(chain))


# Spellings.
@pytest.mark.parametrize("text, hiragana", [("ike", "いけ"), ("イケ", "いけ"), ("zubon", "ずぼん"), ("durai", "づらい"), ("itt", "いっt"), ("itte", "いって"), ("ittt", "いっっt"), ("itttte", "いっっって"), ("nn", "んん"), ("ネコneko", "ねこneko"), ("Di", "ぢ"), ("xtsu", "っ"), ("ltsu", "っ"), ("axtsuta", "あった"), ("", "")])
def test_to_hiragana(text, hiragana):
    assert to_hiragana_text(text) == hiragana


def test_other_directions():
    assert (to_katakana_text("neko"), to_katakana_text("ねこ"), to_romaji_text("ネコ"), to_romaji_text("がっこう")) == ("ネコ", "ネコ", "neko", "gakkou")
    assert (to_romaji_text("しゅみ"), to_romaji_text("attic"), romaji_key_text("Café"), romaji_key_text("がっこう")) == ("shumi", "aっtic", "cafe", "gakkou")


@given(st.text(max_size=20))
def test_scanners_take_anything(text):
    to_romaji_text(text)
    to_katakana_text(text)
