"""Tables with nulls, empty and long texts, repeated rows and clashing columns."""

import random

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars int, size int, target string, h string, fp string, fingerprint string, "
    "component_id string, digest string, copies string, score string, lang_pred string, length string, piece string, start string, row string"
)


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9)))


def sentence(rng, n):
    return " ".join(word(rng) for _ in range(n))


def texts(seed=3):
    """(doc_id, text, lang, source)"""
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    base = sentence(rng, 120)
    near = base.split()
    near[50] = "other"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"),
        (4, passage + " " + sentence(rng, 30), "de", "b"), (5, sentence(rng, 20) + " " + passage, "de", None),
        (6, None, "de", "c"), (7, "", None, "c"), (8, "  \n\t ", "fr", "c"), (9, "123 456 !!", "fr", "d"),
        (None, "Ohne Nummer und Sinn", None, None), (None, "Ohne Nummer und Sinn", None, None),
        (10, sentence(rng, 5000), "en", "e"), (11, "ab " * 900, "en", "e"), (12, "x", "en", "z"), (12, "x", "en", "z"),
        (13, "y" * 3000, None, "é"), (14, "Ünïcödé 日本語 テキスト  a\tb  c\r\nd", "fr", "é"), (15, base.upper(), "en", "Z"),
    ]
    rows += [(100 + i, sentence(rng, rng.randint(1, 40)), rng.choice(["en", "de", "fr", None]), rng.choice("abcdz")) for i in range(60)]
    return rows


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    pad = ("clash",) * 13
    return spark.createDataFrame([(*r, 0, 0, *pad) for r in rows], DOCS).repartition(3)
