"""A small dictionary source."""


def sense(pos=(), gloss=(), misc=(), field=(), dialect=(), related=(), lang="eng"):
    texts = [g if isinstance(g, tuple) else (lang, g) for g in gloss]
    return {
        "partOfSpeech": list(pos), "appliesToKanji": ["*"], "appliesToKana": ["*"], "related": [list(r) for r in related], "antonym": [], "field": list(field), "dialect": list(dialect),
        "misc": list(misc), "info": [], "languageSource": [], "gloss": [{"lang": a, "gender": None, "type": None, "text": t} for a, t in texts],
    }


def entry(i, kanji, kana, senses, common=False):
    return {
        "id": str(i), "kanji": [{"common": common, "text": k, "tags": []} for k in kanji],
        "kana": [{"common": common, "text": k, "tags": [], "appliesToKanji": ["*"]} for k in kana], "sense": senses,
    }


WORDS = [
    entry(1000, ["猫"], ["ねこ"], [sense(["n"], ["cat (esp. the domestic cat)", ("ger", "Katze")])], common=True),
    entry(1010, ["食べる"], ["たべる"], [sense(["v1", "vt"], ["to eat", "to live on"], related=[["食う", 2], ["生", "なま"], ["無い", "ない", 1], [7], []])], common=True),
    entry(1020, ["食べ物"], ["たべもの"], [sense(["n"], ["food"])], common=True),
    entry(1030, ["食べ頃"], ["たべごろ"], [sense(["n"], ["season to eat"])]),
    entry(1040, [], ["たべすぎ"], [sense(["n"], ["overeating"])]),
    entry(1050, ["食べ方"], ["たべかた"], [sense(["n"], ["way of eating"])]),
    entry(1060, ["犬"], ["いぬ"], [sense(["n"], ["dog"])], common=True),
    entry(1070, ["魚"], ["さかな"], [sense(["n"], ["fish"])], common=True),
    entry(1080, ["鳥"], ["とり"], [sense(["n"], ["bird"])], common=True),
    entry(1090, ["花"], ["はな"], [sense(["n"], ["flower"])], common=True),
    entry(1100, ["美しい"], ["うつくしい"], [sense(["adj-i"], ["beautiful"])], common=True),
    entry(1110, ["生"], ["なま"], [sense(["adj-no"], ["raw"])], common=True),
    entry(1120, ["生"], ["せい"], [sense(["n"], ["life"])], common=True),
    entry(1130, [], ["ラーメン"], [sense(["n"], ["ramen"], misc=["uk"])], common=True),
    entry(1140, ["為る"], ["する"], [sense(["vs-i"], ["to do"]), sense(["n"], ["a thing"], misc=["uk"])], common=True),
    entry(1150, ["風邪"], ["かぜ"], [sense(["n"], ["common cold"], field=["med"])], common=True),
    entry(1160, ["阿呆"], ["あほ"], [sense(["n"], ["fool"], dialect=["ksb"], misc=["uk"])]),
    entry(1170, ["直ぐ"], ["すぐ"], [sense(["adv"], ["immediately"], misc=["uk"])], common=True),
    entry(1180, ["走る"], ["はしる"], [sense(["v5r"], ["to run"])], common=True),
]
