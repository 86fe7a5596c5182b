import hashlib
import re
from collections import Counter, defaultdict

from tests.llm import odd

from strandweave.llm import mixing


def brute(rows, weights=(5, 2, 1), most=3):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    total = defaultdict(int)
    for (_, _, _, s), n in zip(rows, size):
        total[s] += n
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(total.values()) - sum(most * total[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        price = left / open_weight if open_weight else 0
        over = {s for s in names if s not in full and most * total[s] <= price * weight[s]}
        if not over:
            break
        full |= over
    for s in names:
        target[s] = most * total[s] if s in full else price * weight[s]
    digest = lambda d, t: int(hashlib.md5((("" if d is None else str(d)) + "\n" + (t or "")).encode()).hexdigest()[:15], 16)
    times = {}
    for s in names:
        if not total[s]:
            continue
        copies = int(target[s] // total[s])
        rest, by_hash = target[s] - copies * total[s], defaultdict(int)
        for (d, t, _, q), n in zip(rows, size):
            if q == s and n:
                by_hash[digest(d, t)] += n
        before = 0
        for h in sorted(by_hash):
            n = by_hash[h]
            more = before + n <= rest or (before <= rest and before + n - rest < rest - before)
            times[s, h] = copies + more
            before += n
    out = Counter()
    for (d, t, _, s), n in zip(rows, size):
        h = digest(d, t)
        out[d, n, total[s], round(target[s], 6), n * times.get((s, h), 0)] += 1
    return out


def test_mix_against_brute_force(spark):
    rows = odd.texts()
    got = mixing.mix(odd.docs(spark)).collect()
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == brute(rows)
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_repeat_gives_whole_rows(spark):
    rows = [(i, "a b c d", "en", "s" if i < 3 else "t") for i in range(200)]
    docs = odd.docs(spark, rows)
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).collect()}
    got = mixing.repeat(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({d: int(n) for d, n in taken.items() if n})
    assert {taken[i] for i in range(3)} == {3}


def test_no_documents_and_no_words(spark):
    assert mixing.mix(odd.docs(spark, [])).collect() == []
    got = mixing.mix(odd.docs(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect()
    assert {(r.doc_id, r["size"], r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_null_and_repeated_ids_come_near_their_targets(spark):
    rows = [(None if i % 2 else 7, f"some words of text {i}", "en", "wxyz"[i % 4]) for i in range(800)]
    got = mixing.mix(odd.docs(spark, rows)).collect()
    assert len(got) == 800
    by_target = Counter()
    for r in got:
        by_target[round(r.target, 6)] += r.taken
    expect = Counter()
    for s in "wxyz":
        expect[round({"w": 5, "x": 2, "y": 1, "z": 5}[s] / 13 * 4000, 6)] += {"w": 5, "x": 2, "y": 1, "z": 5}[s] / 13 * 4000
    assert all(abs(by_target[t] - expect[t]) <= 10 for t in expect) and set(by_target) == set(expect)
