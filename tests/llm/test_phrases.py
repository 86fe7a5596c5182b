import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandweave.llm import phrases
from tests.llm import odd

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER))]


def brute(rows, least=10, words=3, cover=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, words + 1) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    hidden = {}
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = lang, w[i : i + m]
                hidden[key] = max(hidden.get(key, 0), a)
    out = {}
    for (lang, w), a in found.items():
        if 100 * hidden.get((lang, w), -1) >= cover * a:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return sorted((lang, i, p.decode(), -a, x, y, n, -s) for lang, rows in out.items() for i, (s, a, p, x, y, n) in enumerate(sorted(rows)[:top], 1))


def check(spark, rows, **options):
    got = phrases.collocations(odd.docs(spark, rows), **options)
    expect = brute(rows, **{k: v for k, v in options.items() if k not in ("shard", "block")})
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == expect
    return expect


def texts(n=300, seed=1):
    rng = random.Random(seed)
    rows = odd.texts()
    vocab = [odd.word(rng) for _ in range(40)]
    for i in range(n):
        words = [vocab[min(int(rng.expovariate(0.15)), 39)] + rng.choice(["", "", "", "", ",", ".", "\n", "!x", "\t", " "]) for _ in range(rng.randrange(60))]
        rows.append((3000 + i, rng.choice([" ", " ", "  ", "\t "]).join(words), rng.choice(["en", "en", "en", "de", "und", None]), "a"))
    rows += [(5000, "New York City hall. new york CITY hall! " * 12, "fr", "b"), (5001, "a a a a " * 20, "fr", "b"), (5002, "ab\x0bcd\x1cef\x85 gh " * 20, "fr", "b")]
    return rows


def test_against_brute_force(spark):
    assert len(check(spark, texts())) > 100


@pytest.mark.parametrize("options", [{"shard": 7, "block": 300}, {"words": 4, "shard": 60}, {"least": 2, "cover": 90, "top": 25}])
def test_small_shards_and_blocks_and_other_limits(spark, options):
    check(spark, texts(80, 2), **options)


def test_empty_tables(spark):
    check(spark, [])
    check(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "one. two", None, "a")])


def test_blocks_give_the_words_back():
    for text in ("", " ", "..", "a", "a b.c", ".a\t\tb;;c d", "é\xa0x\x1cy  z"):
        vocab, ids = phrases.block_of(text.encode())
        words = [w.decode() for w in vocab.to_pylist()]
        back = [[]]
        for i in ids.tolist():
            if i < 0:
                back.append([])
            else:
                back[-1].append(words[i])
        assert [p for p in back if p] == [p for p in pieces(text) if p]


def test_long_texts_are_cut_between_pieces_only():
    text = b"one two three. four five, " * 50
    parts = list(phrases._bundles([text, b"x", b"y" * 500], 40))
    assert all(len(p) < 80 or p.endswith(b"y" * 500) for p in parts)
    joined = [p for part in parts for p in pieces(part.decode()) if p]
    assert joined == [p for t in (text, b"x", b"y" * 500) for p in pieces(t.decode()) if p]


def test_trie_finds_its_phrases_and_no_others():
    rng = random.Random(8)
    for size in (1, 5, 300, 5000):
        vocab = [f"w{i}" for i in range(max(2, size // 3))]
        known = sorted({(rng.choice("ab"), " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 2, 3])))) for _ in range(size)})
        trie = phrases.Trie([lang for lang, _ in known], pa.array([p.encode() for _, p in known]))
        text = [rng.choice([*vocab, "other"]) for _ in range(4000)]
        local = sorted(set(text))
        ids = np.array([local.index(w) if rng.random() < 0.95 else -1 for w in text], np.int32)
        for lang in "abc":
            expect = set()
            for i, (of, p) in enumerate(known):
                w = p.split()
                if of == lang:
                    expect |= {(len(w), at, i) for at in range(len(text) - len(w) + 1)
                               if all(ids[at + k] >= 0 and text[at + k] == w[k] for k in range(len(w)))}
            got = {(level, int(a), int(f)) for level, at, found in trie.advance(lang, pa.array([w.encode() for w in local]), ids, 3) for a, f in zip(at, found, strict=True)}
            assert got == expect


def test_supports_are_moved_before_they_are_added_up(spark):
    found = spark.createDataFrame([("en", "a b", 6), ("en", "a b", 4), ("en", "b c", 9), ("de", "a b", 9)], "lang string, phrase string, support long")
    frequent = phrases._frequent(found, 10)
    assert [tuple(r) for r in frequent.collect()] == [("en", "a b")]
    above, _, below = frequent._jdf.queryExecution().sparkPlan().toString().partition("Exchange")
    assert "Aggregate" in above and below and "Aggregate" not in below


def test_a_task_that_makes_blocks_holds_few_texts():
    size, rng, given, most = 1000, random.Random(3), 0, 0
    rows = [(f"l{rng.randrange(500)}", "word " * rng.randrange(40)) for _ in range(4000)] + [("en", "A b. " * 20)] * 500

    def batches():
        nonlocal given
        for lo in range(0, len(rows), 50):
            batch = rows[lo : lo + 50]
            given += sum(len(text) for _, text in batch)
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in batch]), pa.array([text for _, text in batch])], ["lang", "text"])

    told, taken = {}, 0
    for lang, blob in phrases._gathered(batches(), size):
        told.setdefault(lang, []).append(blob)
        taken += len(blob)
        most = max(most, given - taken)
    assert most <= phrases.HELD * size + 50 * 200
    assert len(told["en"]) < 60  # filled across batches: 50,000 bytes
    for lang in ("en", "l0"):
        assert sum(b.count(b"word") + b.count(b"a b") for b in told[lang]) == sum(t.count("word") + t.count("A b") for at, t in rows if at == lang)


def test_a_reader_holds_two_blocks_at_once(spark):
    stored = phrases.blocks(odd.docs(spark, texts()), 300)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in stored.inputFiles()]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(groups) == stored.count() > 2 * len(files) and max(groups) <= 2
