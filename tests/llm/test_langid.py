import math
from collections import Counter

import regex

from navspark.llm.langid import decide, identify, learn

TEXTS = [
    ("en", "the house and the garden of the old man with that dog"),
    ("de", "das haus und der garten von dem alten mann mit seinem hund"),
    ("fr", "la maison et le jardin du vieil homme avec son chien"),
]


def rows():
    return [(3 * i + j, text, lang, "a") for i in range(5) for j, (lang, text) in enumerate(TEXTS)]


def test_known_words_and_back_off(documents):
    model = learn(documents(rows()))
    assert model["langs"] == ["de", "en", "fr"]
    assert decide("THE dog!", model, {})[0] == "en"
    assert decide("gartenhaus mannes", model, {})[0] == "de"  # no word of these is known
    assert decide("jardins 123", model, {})[0] == "fr"
    asked = [(1, None, None, None), (2, "", None, None), (3, "123 %% -- ²", None, None), (4, "der hund " * 5000, None, None), (4, "le chien", None, None)]
    frame = documents(asked)
    out = identify(frame, model)
    assert set(frame.columns) <= set(out.columns)
    found = sorted((r["doc_id"], r["lang_pred"]) for r in out.collect())
    assert found == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "fr")]
    assert all(0 <= r["score"] <= 1 for r in out.collect())


def test_small_language_keeps_its_statistics(documents):
    # 1,200,000 words, 0.1% of them German: each of its words makes up less than 2 in a million of all.
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = ["qx" + letters[i // 676] + letters[i // 26 % 26] + letters[i % 26] + "zü" for i in range(1200)]
    common = " ".join(["the house and garden"] * 3000)
    frame = documents([(i, common, "en", "a") for i in range(100)] + [(1000, " ".join(rare), "de", "a")], extra=False)
    model = learn(frame)
    assert set(rare) <= set(model["words"])
    assert {"abzü", "bazü"} <= set(model["grams"][4])
    assert decide(rare[7], model, {})[0] == "de"
    # Still bounded by each language's own share.
    assert set(learn(frame, word_share=0.01)["words"]) == {"the", "house", "and", "garden"}


def test_nothing_to_learn_from(documents):
    for frame in (documents([]), documents([(1, "abc", None, None), (2, None, "en", None), (3, "12", "en", None)])):
        model = learn(frame)
        assert model["langs"] == []
        assert [r["lang_pred"] for r in identify(documents(rows()[:2]), model).collect()] == ["und", "und"]
    assert identify(documents([]), model).collect() == []


HINDI = "यह किताब बहुत अच्छी है और मैं इसे रोज़ पढ़ता हूँ क्योंकि कहानी में हिन्दी की मिठास है"
NEPALI = "यो किताब धेरै राम्रो छ र म यसलाई दिनहुँ पढ्छु किनभने कथामा नेपाली मिठास छ"
ARABIC = "هَذَا كِتَابٌ جَمِيلٌ وَأَنَا أَقْرَأُهُ كُلَّ يَوْمٍ"


def marked():
    texts = [("hi", HINDI), ("ne", NEPALI), ("ar", ARABIC), *TEXTS]
    return [(10 * i + j, text, lang, "a") for i in range(20) for j, (lang, text) in enumerate(texts)]


def test_words_with_marks_are_known(documents):
    model = learn(documents(marked()))
    for lang, text in (("hi", HINDI), ("ne", NEPALI), ("ar", ARABIC)):
        for word in text.split():
            assert word in model["words"], word
        assert decide(text, model)[0] == lang
    # Shared by both: "किताब"; in Hindi only: "हिन्दी".
    assert decide("हिन्दी", model)[0] == "hi" and decide("नेपाली", model)[0] == "ne"
    assert decide("ि ् ँ", model) == ("und", 0.0)  # marks alone are no letters


def by_hand(rows, text, word_share=2e-6, gram_share=1e-5):
    """Scores from plain dictionaries, a word at a time."""
    split = lambda t: regex.findall(r"[\p{L}\p{M}]+", t.lower())
    langs = sorted({r[2] for r in rows})
    tables = {}
    for order in (0, 4, 3, 2, 1):
        count = {}
        for _, t, lang, _ in rows:
            for w in split(t):
                whole = f"_{w}_" if order > 1 else w
                for g in [w] if not order else [whole[i : i + order] for i in range(len(whole) - order + 1)]:
                    count.setdefault(g, Counter())[lang] += 1
        total = {lang: sum(c[lang] for c in count.values()) for lang in langs}
        share = gram_share if order else word_share
        count = {g: c for g, c in count.items() if any(c[lang] and c[lang] >= share * total[lang] for lang in langs)}
        tables[order] = {g: [math.log(c[lang] + 0.5) - math.log(total[lang] + 0.5 * (len(count) + 1)) for lang in langs] for g, c in count.items()}
    sums, n = [0.0] * len(langs), 0
    for w in split(text):
        found = [tables[0][w]] if w in tables[0] else []
        for order in (4, 3, 2, 1):
            if not found:
                whole = f"_{w}_" if order > 1 else w
                found = [tables[order][g] for i in range(len(whole) - order + 1) if (g := whole[i : i + order]) in tables[order]]
        if found:
            n += 1
            sums = [s + sum(f[i] for f in found) / len(found) for i, s in enumerate(sums)]
    shares = [math.exp((s - max(sums)) * min(1, 20 / max(n, 1))) for s in sums]
    return langs[sums.index(max(sums))], 1 / sum(shares)


def test_scores_equal_plain_counting(documents):
    rows = marked()
    asked = [HINDI, NEPALI[:40], "THE old किताब और jardin", "gartenhäuser zzz qqq", "ΣΑΣ the DOG İstanbul", "die hunde " * 40, "xyz"]
    for shares in ({}, {"word_share": 0.02, "gram_share": 0.01}):
        model = learn(documents(rows), **shares)
        out = identify(documents([(i, t, None, None) for i, t in enumerate(asked)]).repartition(3), model)
        for r in out.collect():
            lang, score = by_hand(rows, asked[r["doc_id"]], **shares)
            assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-9
