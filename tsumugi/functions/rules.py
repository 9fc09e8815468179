"""The rules that undo one step of inflection, built from the conjugation classes.

A rule is (ending, replacement, from_type, to_type, reasons). Rules of one ending apply in the order
in which they are listed; rules of different endings of one length never meet.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

ICHIDAN, GODAN, IADJ, KURU, SURU, SPECIAL_SURU, NOUN_VS = (1 << k for k in range(7))
ANY = (1 << 7) - 1
INITIAL, TA_TE, DA_DE, MASU, IRREALIS = (1 << k for k in range(7, 12))


class Rule(NamedTuple):
    ending: str
    replacement: str
    from_type: int
    to_type: int
    reasons: tuple[str, ...] = ()


#: A godan verb's ending, then its a, i, e and o stems.
GODAN_ROWS = ("うわいえお", "くかきけこ", "ぐがぎげご", "すさしせそ", "つたちてと", "ぬなにねの", "ぶばびべぼ", "むまみめも", "るらりれろ")
#: Sound changes before た and だ: the changed ending, the type, the verb endings.
ONBIN = (("い", TA_TE, "く"), ("い", DA_DE, "ぐ"), ("し", TA_TE, "す"), ("っ", TA_TE, "うつる"), ("ん", DA_DE, "ぬぶむ"))
#: Verbs that keep う before た.
U_BEFORE_TA = ("たゆたう", "たゆとう", "のたまう", "のたもう", "たまう", "たもう", "揺蕩う", "おう", "こう", "そう", "とう", "請う", "乞う", "恋う", "問う", "負う", "沿う", "添う", "副う", "厭う", "給う", "賜う", "宣う", "曰う")
#: Forms of 行く and its kin before た.
IKU = ("いっ", "行っ", "逝っ", "往っ")
#: Honorific verbs in る whose masu stem ends in い; the first group also has that form as its imperative.
HONORIFIC = ("いらっしゃる", "おっしゃる", "くださる", "下さる", "なさる", "仰る")
HONORIFIC_STEM_ONLY = ("てらっしゃる", "でらっしゃる", "ござる", "ご座る", "御座る")

#: Fixed values, applied before the godan rules of the same ending: ending, replacement, from, to, reasons.
FIRST = """
き い INITIAL IADJ Ki
さ い INITIAL IADJ Noun
て - INITIAL TA_TE Te
そう - INITIAL MASU Sou
そう い INITIAL IADJ Sou
なさい - INITIAL MASU Respectful Imperative
"""
#: Fixed values, applied after them.
THEN = """
くありません い INITIAL IADJ PoliteNegative
ませんでした - INITIAL MASU PolitePastNegative
ましたら - INITIAL MASU Polite Tara
ましたり - INITIAL MASU Polite Tari
ましょう - INITIAL MASU PoliteVolitional
ました - INITIAL MASU PolitePast
まして - INITIAL MASU Polite Te
ません - INITIAL MASU PoliteNegative
ます - INITIAL MASU Polite
ませ - INITIAL MASU Polite Imperative
かったら い INITIAL IADJ Tara
かったり い INITIAL IADJ Tari
かった い INITIAL IADJ Past
くない い IADJ IADJ Negative
ければ い INITIAL IADJ Ba
くて い INITIAL IADJ Te
く い INITIAL IADJ Adv
たい - IADJ MASU Tai
ない - IADJ IRREALIS Negative
ないで - INITIAL IRREALIS NegativeTe
ぬ - INITIAL IRREALIS Negative
ん - INITIAL IRREALIS Negative
ず - INITIAL IRREALIS Zu
な - INITIAL ICHIDAN|GODAN|KURU|SURU ImperativeNegative
させる る ICHIDAN ICHIDAN|KURU Causative
させる する ICHIDAN SURU Causative
せる - ICHIDAN IRREALIS Causative
される - ICHIDAN IRREALIS CausativePassive
される する ICHIDAN SURU Passive
れる - ICHIDAN IRREALIS Passive
られる る ICHIDAN ICHIDAN|KURU PotentialOrPassive
よう る INITIAL ICHIDAN|KURU Volitional
い る INITIAL KURU Imperative
よ る INITIAL ICHIDAN Imperative
ろ る INITIAL ICHIDAN Imperative
得る - ICHIDAN MASU EruUru
なさる - GODAN MASU Respectful
なさる - GODAN NOUN_VS SuruNoun Respectful
になる - GODAN MASU Respectful
になる - GODAN NOUN_VS SuruNoun Respectful
いたす - GODAN MASU Humble
いたす - GODAN NOUN_VS SuruNoun Humble
致す - GODAN MASU Humble
致す - GODAN NOUN_VS SuruNoun Humble
する - SURU NOUN_VS SuruNoun
しないで する INITIAL SURU NegativeTe
しない する IADJ SURU Negative
しうる する INITIAL SURU EruUru
しえる する ICHIDAN SURU EruUru
しよう する INITIAL SURU Volitional
しろ する INITIAL SURU Imperative
せよ する INITIAL SURU Imperative
せず する INITIAL SURU Zu
せぬ する INITIAL SURU Negative
せん する INITIAL SURU Negative
できる する ICHIDAN SURU Potential
し する TA_TE SURU
さないで する INITIAL SPECIAL_SURU Irregular NegativeTe
さない する IADJ SPECIAL_SURU Irregular Negative
さず する INITIAL SPECIAL_SURU Irregular Zu
しさせる する ICHIDAN SPECIAL_SURU Irregular Causative
せさせる する ICHIDAN SPECIAL_SURU Irregular Causative
ぜさせる ずる ICHIDAN SPECIAL_SURU Irregular Causative
しられる する ICHIDAN SPECIAL_SURU Irregular PotentialOrPassive
せられる する ICHIDAN SPECIAL_SURU Irregular PotentialOrPassive
ぜられる ずる ICHIDAN SPECIAL_SURU Irregular PotentialOrPassive
せば する INITIAL SPECIAL_SURU Irregular Ba
ずれば ずる INITIAL SPECIAL_SURU Irregular Ba
ぜず ずる INITIAL SPECIAL_SURU Irregular Zu
ぜぬ ずる INITIAL SPECIAL_SURU Irregular Negative
ぜよ ずる INITIAL SPECIAL_SURU Irregular Imperative
せ する INITIAL SPECIAL_SURU Irregular Imperative
そう する INITIAL SPECIAL_SURU Irregular Volitional
こさせる くる ICHIDAN KURU Causative
こられる くる ICHIDAN KURU PotentialOrPassive
これる くる ICHIDAN KURU Potential
来れる 来る ICHIDAN KURU Potential
來れる 來る ICHIDAN KURU Potential
こよう くる INITIAL KURU Volitional
こい くる INITIAL KURU Imperative
き くる TA_TE KURU
き くる MASU KURU MasuStem
こ くる IRREALIS KURU
"""
#: What follows a ta/te stem; each has a twin after a da/de stem, with its first sound voiced.
AFTER_TA_TE = """
ていらっしゃい INITIAL Respectful Continuous Imperative
ていらっしゃる GODAN Respectful Continuous
てらっしゃい INITIAL Respectful Continuous Imperative
てらっしゃる GODAN Respectful Continuous
ている ICHIDAN Continuous
ておる GODAN HumbleOrKansaiDialect Continuous
てる ICHIDAN Continuous
とる GODAN HumbleOrKansaiDialect Continuous
とく GODAN Toku
ちゃう GODAN Chau
たら INITIAL Tara
たり INITIAL Tari
た INITIAL Past
"""
_VOICED = str.maketrans("たちてと", "だじでど")


def _types(names: str) -> int:
    return sum(globals()[n] for n in names.split("|"))


def _listed(text: str) -> list[Rule]:
    out = []
    for line in text.split("\n"):
        if line:
            ending, replacement, source, target, *reasons = line.split(" ")
            out.append(Rule(ending, "" if replacement == "-" else replacement, _types(source), _types(target), tuple(reasons)))
    return out


def _godan() -> list[Rule]:
    stems, changed, forms = [], [], []
    for u, a, i, e, o in GODAN_ROWS:
        stems.append(Rule(i, u, MASU, GODAN, ("MasuStem",)))
        stems.append(Rule(a, u, IRREALIS, GODAN))
        forms.append(Rule(e, u, INITIAL, GODAN, ("Imperative",)))
        conditional, potential = (ICHIDAN | GODAN | KURU | SURU, ICHIDAN | GODAN) if u == "る" else (GODAN, GODAN)
        forms.append(Rule(e + "ば", u, INITIAL, conditional, ("Ba",)))
        forms.append(Rule(e + "る", u, ICHIDAN, potential, ("Potential",)))
        forms.append(Rule(o + "う", u, INITIAL, GODAN, ("Volitional",)))
    for ending, kind, verbs in ONBIN:
        changed += [Rule(ending, u, kind, GODAN) for u in verbs]
    # The suru verb's masu stem stands between す's masu stem and its sound change.
    return stems + [Rule("し", "する", MASU, SURU, ("MasuStem",))] + changed + forms


def _after_stems() -> list[Rule]:
    out = []
    for line in filter(None, AFTER_TA_TE.split("\n")):
        ending, source, *reasons = line.split(" ")
        for e, stem in ((ending, TA_TE), (ending[0].translate(_VOICED) + ending[1:], DA_DE)):
            out.append(Rule(e, "", _types(source), stem, tuple(reasons)))
    out.append(Rule("で", "", INITIAL, DA_DE, ("Te",)))  # て itself stands in FIRST
    return out


def _honorifics() -> list[Rule]:
    out = []
    for verb in HONORIFIC + HONORIFIC_STEM_ONLY:
        out.append(Rule(verb[:-1] + "い", verb, MASU, GODAN, ("MasuStem",)))
        if verb in HONORIFIC:
            out.append(Rule(verb[:-1] + "い", verb, INITIAL, GODAN, ("Imperative",)))
    return out


def _compounds() -> list[Rule]:
    out = [Rule(f"ざる{wo}{e}{end}", "", IADJ, IRREALIS, ("ZaruWoEnai",)) for wo in ("を", "") for e in ("え", "得") for end in ("ない", "ぬ")]
    for sugi in ("すぎ", "過ぎ"):
        for ending, source in ((sugi + "る", ICHIDAN), (sugi, INITIAL)):
            out += [Rule(ending, "い", source, IADJ, ("Sugiru",)), Rule(ending, "", source, MASU, ("Sugiru",))]
    return out


def all_rules() -> list[Rule]:
    before_ta = [Rule(v, v, TA_TE, GODAN) for v in U_BEFORE_TA] + [Rule(v, v[:-1] + "く", TA_TE, GODAN) for v in IKU]
    return _listed(FIRST) + _godan() + _after_stems() + _listed(THEN) + _honorifics() + _compounds() + before_ta


def by_ending() -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = defaultdict(list)
    for rule in all_rules():
        out[rule.ending].append(rule)
    return dict(out)
