import random

from provgraph.llm import language_id


def test_rare_languages_and_long_words_are_learnt(frame, monkeypatch):
    """A language with few of many texts, and one written without spaces."""
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 20)
    r = random.Random(6)
    voices = {"aa": ["ka", "ki", "ku", "ta"], "bb": ["sch", "lich", "ung", "ber"], "zz": ["мо", "ре", "ло", "ви"]}
    text = lambda g, n: (" " if g != "zz" else "").join("".join(r.choice(voices[g]) for _ in range(3)) for _ in range(n))
    docs = [(i, text(g, 30), g) for i, g in enumerate(["aa"] * 400 + ["bb"] * 8 + ["zz"] * 8)]
    langs, logp = language_id.learn(frame(docs))
    assert langs == ["aa", "bb", "zz"]
    out = {x.doc_id: x.lang_pred for x in language_id.predicted(frame(docs), langs, logp).collect()}
    assert out == {i: g for i, _, g in docs}
