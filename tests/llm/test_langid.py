import zlib

import numpy as np
from tests.llm import odd

from strandweave.llm import langid

SAMPLES = {
    "en": "the quick brown fox and the lazy dog were walking through this old forest with their friends",
    "de": "der schnelle braune Fuchs und der faule Hund gingen durch diesen alten Wald mit ihren Freunden",
    "fr": "le renard brun rapide et le chien paresseux marchaient dans cette vieille forêt avec leurs amis",
}


def test_predictions_on_odd_rows(spark):
    rows, i = [], 0
    for lang, text in SAMPLES.items():
        words = text.split()
        for k in range(40):
            rows.append((i, " ".join(words[k % 7 :] + words[: k % 7]), lang, "s"))
            i += 1
    rows += [(None if r[0] is None else r[0] + 1000, *r[1:]) for r in odd.texts()[5:14]]
    got = langid.identify(odd.docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [f for f in got[0].asDict()] == ["doc_id", "held_out", "lang_pred", "score"]
    by_id = {r.doc_id: r for r in got}
    for d in range(i):
        assert by_id[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert by_id[d].lang_pred == rows[d][2] and 0 <= by_id[d].score <= 1
    for d in (1006, 1007, 1008, 1009):  # null, empty, blanks, no letter
        assert (by_id[d].lang_pred, by_id[d].score) == (langid.UNKNOWN, 0.0)
    assert by_id[None].held_out is False


def test_nothing_to_learn_from(spark):
    got = langid.identify(odd.docs(spark, [(1, "some text", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [(langid.UNKNOWN, 0.0)]
    assert langid.identify(odd.docs(spark, [])).collect() == []


def test_n_grams_are_those_of_the_words():
    def brute(text):
        shape = "".join(c if c.isalpha() else " " for c in text.lower())
        padded = " " + " ".join(shape.split()) + " "
        return sum(any(c != " " for c in padded[i : i + n]) for n in langid.ORDERS for i in range(len(padded) - n + 1))

    for text in ("a", "ab cd", "Straße 12", "日本 x", "one, two"):
        # a mark at the end leaves one blank more before the edge
        assert abs(len(langid.gram_buckets(text)) - brute(text)) <= 2
    assert len(langid.gram_buckets("12 !?")) == 0
    assert np.array_equal(np.sort(langid.gram_buckets("ABC, d")), np.sort(langid.gram_buckets("abc  d")))


def test_the_sample_bound_keeps_all_languages(spark):
    rows = [(i, f"{SAMPLES[lang]} {i}", lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 300)]
    langs, matrix = langid.fit(odd.docs(spark, rows), max_rows=30)
    assert langs == ["de", "en", "fr"] and matrix.shape == (langid.BUCKETS, 3)
