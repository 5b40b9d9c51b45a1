import numpy as np

from tests.llm.conftest import DOCS
from tuneframe.llm import langid

EN = "the cat and the dog went over the hill with their friends and then came home again "
FR = "le chat et le chien sont partis dans la forêt avec leurs amis puis sont revenus chez eux "


def test_held_out_texts(rows, odd, empty):
    data = [(i, (EN if i % 2 else FR) * (1 + i % 3), "en" if i % 2 else "fr", None, 0) for i in range(40)]
    model = langid.fit(rows(DOCS, data))
    assert model.languages == ["en", "fr"]
    judged = langid.identify(rows(DOCS, [(1, "the dog and the hill", None, None, 0), (2, "la forêt et le chien", None, None, 0)]), model)
    assert {r["doc_id"]: r["lang_pred"] for r in judged.collect()} == {1: "en", 2: "fr"}
    got = langid.identify(odd, model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 7, 8))
    assert langid.identify(empty, model).count() == 0
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def test_few_letters_and_rare_languages(rows):
    common = [(i, EN + str(i), "en", None, 0) for i in range(400)]
    model = langid.fit(rows(DOCS, [*common, *[(i, FR, "fr", None, 0) for i in range(2)], (9, None, "xx", None, 0)]), sample=20)
    assert model.languages == ["en", "fr"]  # a language of two documents is learned from both
    texts = ["a", "I", "5 x 7", "é", "7", "", None, "!?", "la forêt et le chien"]
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.identify(rows(DOCS, [(i, t, None, None, 0) for i, t in enumerate(texts)]), model).collect()}
    assert all(got[t] == ("en", 0.0) for t in ("a", "I", "5 x 7"))  # letters, but no n-gram: the first language
    assert got["é"][0] in ("en", "fr") and all(got[t] == ("und", 0.0) for t in ("7", "", None, "!?"))
    assert got["la forêt et le chien"][0] == "fr"


def test_scores_against_plain_counting(rows):
    """Hits of n-grams in Python sets, corrected for the filter's chance hits."""
    data = [(i, (EN if i % 2 else FR) * 2 + f"word{i} ", "en" if i % 2 else "fr", None, 0) for i in range(30)]
    model = langid.fit(rows(DOCS, data))

    def grams(text):
        letters = "".join(c if c.isalpha() else " " for c in text.replace("É", "É"))
        code = b" " + b" ".join(w.encode().lower() for w in letters.split()) + b" "
        return [code[i : i + 4] for i in range(len(code) - 3)]

    sets = {}
    for _, text, lang, *_ in data:
        sets.setdefault(lang, []).extend(grams(text))
    members = {lang: {g for g in found if found.count(g) >= langid.MIN_SHARE * len(found)} for lang, found in sets.items()}
    texts = ["the dog and the hill", "la forêt et le chien", "quite unlike zzz", "word3 word5 le chat"]
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.identify(rows(DOCS, [(i, t, None, None, 0) for i, t in enumerate(texts)]), model).collect()}
    for text in texts:
        own = grams(text)
        shares = [max(0.0, (sum(g in members[lang] for g in own) / len(own) - c) / (1 - c)) for lang, c in zip(model.languages, model.chance)]
        best = int(np.argmax(shares))
        assert got[text][1] >= shares[best] - 1e-9 and abs(got[text][1] - shares[best]) < 0.02  # a filter only ever adds hits
        assert got[text][0] == model.languages[best] or max(shares) - min(shares) < 0.02


def test_clashing_columns(clashing):
    model = langid.fit(clashing)
    got = langid.identify(clashing, model)
    assert got.columns.count("score") == 1 and {r["lang_pred"] for r in got.collect()} == {"en"}


def test_filter_has_no_false_negatives_and_many_languages():
    members = {f"l{i:02d}": np.arange(i * 1000, i * 1000 + 500, dtype=np.uint32) for i in range(20)}
    model = langid.LanguageFilter.build(sorted(members), members)
    assert model.slots.shape[1] == 3
    for i, name in enumerate(sorted(members)):
        first, *rest = langid._slots(members[name], langid.SLOT_BITS, langid.HASHES)
        found = model.slots[first]
        for at in rest:
            found = found & model.slots[at]
        assert np.all((found[:, i // 8] >> (i % 8)) & 1)


def test_blocks_of_long_texts():
    data = np.frombuffer((EN * 30000).encode(), np.uint8)
    assert sum(map(len, langid.grams(data))) > len(EN) * 29000
