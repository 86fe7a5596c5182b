"""Phrase collocations, counted with broadcast double-array tries.

The corpus is stored once as blocks: the distinct words of some megabytes of one
language and the text as numbers of these. Level by level, candidates are
phrases that can still be frequent: all neighbouring pairs of words, then longer
phrases both of whose parts (all but the last word, all but the first) have been
found frequent at their place. Their support is added up only as far as the
threshold; what reaches it goes into tries.

A trie's first symbol is the language, each further one a word, written as two
digits so that one node has few possible children. Phrases are dealt to shards
of at most ``SHARD`` by a hash. A shard's double array is built in one task and
broadcast; each task then advances the states of all positions of a block at
once, one digit after another, and counts the accepting states. Spark adds up
the counts of all tasks. So a broadcast is bounded whatever the corpus; a larger
one takes more passes over the blocks, which are a fraction of the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.common import save, small_batches

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
SHARD = 500_000
BLOCK = 2_000_000
#: A task that makes blocks holds texts of at most this many blocks, whatever the number of languages.
HELD = 8
NO_LANG = "und"
_BREAKS = rb"[.,;:!?\x0A-\x0D]"
_BREAK = re.compile(_BREAKS)
#: What a byte is: 0 a blank between words, 1 the end of a piece, 2 part of a word.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, 0x09]] = 0
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 1


def block_of(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of a text and the text as their numbers (int32), with -1 between pieces."""
    data = np.frombuffer(blob, np.uint8)
    kind = _CLASS[data]
    inside = kind == 2
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = words.dictionary_encode()
    piece = np.cumsum(kind == 1, dtype=np.int32)[starts] if len(starts) else np.empty(0, np.int32)
    gaps = np.concatenate([[0], np.cumsum(np.diff(piece) > 0)]) if len(starts) else np.empty(0, np.int64)
    ids = np.full(len(starts) + (int(gaps[-1]) if len(gaps) else 0), -1, np.int32)
    ids[np.arange(len(starts)) + gaps] = coded.indices.to_numpy()
    return coded.dictionary, ids


def _bundles(texts: list[bytes], size: int):
    """Texts joined by line ends to about ``size`` bytes; longer ones are cut where a piece ends."""
    held, total = [], 0
    for text in texts:
        while len(text) > 2 * size:
            at = _BREAK.search(text, size)
            if at is None:
                break
            yield text[: at.start()]
            text = text[at.start() :]
        held.append(text)
        total += len(text)
        if total >= size:
            yield b"\n".join(held)
            held, total = [], 0
    if held:
        yield b"\n".join(held)


def _gathered(batches, size: int):
    """(language, text of about ``size`` bytes) from batches of ``lang, text``; what is not full waits for the next batch."""
    held, total = {}, 0
    for batch in small_batches(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            mine = held.setdefault(lang, [0])
            mine.append(text.lower())
            mine[0] += len(text)
            total += len(text)
            for full in [lang] if mine[0] >= size else list(held) if total >= HELD * size else []:
                length, *texts = held.pop(full)
                total -= length
                for blob in _bundles(texts, size):
                    yield full, blob
    for lang, (_, *texts) in held.items():
        for blob in _bundles(texts, size):
            yield lang, blob


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``block, lang, words, vocab, ids`` of all texts, stored; A-Z are lower-cased, a null language is ``und``.

    ``vocab`` is the words joined by blanks, so that Spark moves one value and not each word. Two blocks are a row
    group, so that a reader holds two at once and not a whole file.
    """
    rows = docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("_lang"), F.col("text").cast("string").alias("_text"))

    def run(batches):
        for lang, blob in _gathered(batches, size):
            vocab, ids = block_of(blob)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([int((ids >= 0).sum())]), pa.array([b" ".join(vocab.to_pylist())], pa.binary()), pa.array([ids.tobytes()], pa.binary())],
                ["lang", "words", "vocab", "ids"])

    made = rows.mapInArrow(run, "lang string, words long, vocab binary, ids binary")
    return save(made.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks", **{"parquet.block.row.count.limit": 2})


def _block_rows(batch: pa.RecordBatch):
    """(row, language, vocabulary, ids) of each block of a batch with columns ``block, lang, words, vocab, ids``."""
    for i in range(batch.num_rows):
        words = batch.column(3).slice(i, 1)
        vocab = pc.split_pattern(words, b" ").flatten() if len(words[0].as_buffer()) else pa.array([], pa.binary())
        yield i, batch.column(1)[i].as_py(), vocab, np.frombuffer(batch.column(4)[i].as_buffer(), np.int32)


def _supports(lang: str, vocab: pa.Array, ids: np.ndarray, at: np.ndarray, words: int, least: int):
    """``lang, phrase, support`` of the distinct phrases of ``words`` words that begin at ``at``."""
    code = ids[at].astype(np.int64)
    for k in range(1, words):
        if k > 1:  # number the prefixes, so that codes stay below 2 ** 63
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(vocab) + ids[at + k]
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    parts = [vocab.take(pa.array(ids[at[first] + k])) for k in range(words)]
    phrases = pc.binary_join_element_wise(*parts, b" ").cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), phrases, pa.array(np.minimum(count, least).astype(np.int64))], ["lang", "phrase", "support"])


def _frequent(found: DataFrame, least: int) -> DataFrame:
    """``lang, phrase`` of those whose supports reach ``least``.

    Rows are moved before they are added up: a block has told each of its phrases once, most occur in one block of a
    task only, and a map of all of them there would take more memory than any other step.
    """
    moved = found.repartition("lang", "phrase")
    return moved.groupBy("lang", "phrase").agg(F.sum("support").alias("support")).where(F.col("support") >= least).select("lang", "phrase")


def pairs(stored: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """``lang, phrase`` of neighbouring words that occur ``least`` times or more."""

    def run(batches):
        for batch in batches:
            for _, lang, vocab, ids in _block_rows(batch):
                at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
                if len(at):
                    yield _supports(lang, vocab, ids, at, 2, least)

    return save(_frequent(stored.mapInArrow(run, "lang string, phrase string, support long"), least), "candidates")


def longer(stored: DataFrame, marks: DataFrame, words: int, least: int = MIN_COUNT) -> DataFrame:
    """``lang, phrase`` of ``words`` words occurring ``least`` times whose two parts of one word less are frequent; ``marks`` says where those begin."""
    merged = marks.groupBy("block").agg(F.collect_list("bits").alias("bits"))

    def run(batches):
        for batch in batches:
            for i, lang, vocab, ids in _block_rows(batch):
                sets = [np.frombuffer(b, np.uint8) for b in batch.column(5)[i].as_py()]
                bits = np.unpackbits(np.bitwise_or.reduce(sets), count=len(ids)).astype(bool)
                at = np.flatnonzero(bits[:-1] & bits[1:])
                if len(at):
                    yield _supports(lang, vocab, ids, at, words, least)

    return save(_frequent(stored.join(merged, "block").mapInArrow(run, "lang string, phrase string, support long"), least), "candidates")


def _width(words: int) -> int:
    """Two digits of this many values number all words."""
    return 1 << ((max(words, 2) - 1).bit_length() + 1) // 2


class Trie:
    """Double array over (language, word, word, ...): the child of state ``s`` by digit ``c`` is ``base[s] + c`` if ``check`` there is ``s``."""

    def __init__(self, langs: list[str], phrases: pa.Array):
        """``phrases``: binary, space-joined words, distinct within a language; phrase ``i`` is in language ``langs[i]``."""
        split = pc.split_pattern(phrases, b" ")
        flat = split.flatten().dictionary_encode()
        self.words = flat.dictionary
        self.width = _width(len(self.words))
        self.langs = {lang: i for i, lang in enumerate(sorted(set(langs)))}
        sizes = np.diff(split.offsets.to_numpy())
        firsts = split.offsets.to_numpy()[:-1] - split.offsets.to_numpy()[0]
        codes = flat.indices.to_numpy().astype(np.int64)
        self._place(*self._nodes(np.array([self.langs[lang] for lang in langs], np.int64), codes, firsts, sizes))

    def _nodes(self, lang, codes, firsts, sizes):
        """Parent, digit and number of children of each node, the nodes that phrases end at; node 0 is the root."""
        at, parents, digits, total = np.zeros(len(lang), np.int64), [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
        alive = np.arange(len(lang))
        ends = np.zeros(len(lang), np.int64)

        def grow(symbol, span):
            nonlocal total
            key, inverse = np.unique(at[alive] * span + symbol, return_inverse=True)
            parents.append(key // span)
            digits.append(key % span)
            at[alive] = total + inverse
            total += len(key)

        grow(lang, max(len(self.langs), 1))
        for k in range(int(sizes.max(initial=0))):
            alive = alive[sizes[alive] > k]
            word = codes[firsts[alive] + k]
            grow(word // self.width, self.width)
            grow(word % self.width, self.width)
            done = alive[sizes[alive] == k + 1]
            ends[done] = at[done]
        return np.concatenate(parents), np.concatenate(digits), ends

    def _place(self, parents, digits, ends):
        """Gives each node with children a base that leads all of them to free places, those with most children first."""
        n, rng = len(parents), np.random.default_rng(11)
        span = max(self.width, len(self.langs), 2)
        size = 2 * n + 2 * span
        taken = np.zeros(size, bool)
        taken[0] = True
        base, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.argsort(parents[1:], kind="stable") + 1
        kids = np.bincount(parents[1:], minlength=n) if n > 1 else np.zeros(n, np.int64)
        begin = np.concatenate([[0], np.cumsum(kids)])[:-1]
        size_class = np.where(kids > 0, np.ceil(np.log2(np.maximum(kids, 1))).astype(np.int64), -1)
        for c in range(int(size_class.max(initial=-1)), -1, -1):
            left = np.flatnonzero(size_class == c)
            while len(left):
                if c == 0:  # one child: any free place does
                    free = np.flatnonzero(~taken[span:]) + span
                    if len(free) < len(left):
                        taken = np.concatenate([taken, np.zeros(len(left), bool)])
                        continue
                    child = order[begin[left]]
                    place[child] = free[: len(left)]
                    base[left] = place[child] - digits[child]
                    taken[place[child]] = True
                    break
                count = kids[left]
                firsts = np.cumsum(count) - count
                child = order[np.repeat(begin[left] - firsts, count) + np.arange(count.sum())]
                guess = rng.integers(1, len(taken) - span, len(left))
                to = np.repeat(guess, count) + digits[child]
                owner = np.repeat(np.arange(len(left)), count)
                won = np.full(len(taken), -1, np.int64)
                won[to] = owner
                good = np.logical_and.reduceat(~taken[to] & (won[to] == owner), firsts)
                mine = good[owner]
                base[left[good]] = guess[good]
                place[child[mine]] = to[mine]
                taken[to[mine]] = True
                if good.sum() * 8 < len(left):
                    taken = np.concatenate([taken, np.zeros(max(2 * span, len(taken) // 8), bool)])
                left = left[~good]
        total = int(place.max(initial=0)) + 1
        self.base = np.zeros(total, np.int32)
        self.base[place] = base
        self.check = np.full(total + span + int(base.max(initial=0)), -1, np.int32)
        self.check[place[1:]] = place[parents[1:]]
        self.accept = np.full(total, -1, np.int32)
        self.accept[place[ends]] = np.arange(len(ends))

    @classmethod
    def load(cls, row: pa.Table) -> Trie:
        """The trie that one task built and stored."""
        trie = cls.__new__(cls)
        trie.langs = {lang: i for i, lang in enumerate(row["langs"][0].as_py())}
        trie.words = row["words"].combine_chunks().values
        trie.width = _width(len(trie.words))
        trie.base, trie.check, trie.accept = (np.frombuffer(row[c][0].as_buffer(), np.int32) for c in ("base", "check", "accept"))
        return trie

    def step(self, states: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``states`` have a child by ``digits``, and these children."""
        to = self.base[states] + digits
        kept = np.flatnonzero(self.check[to] == states)
        return kept, to[kept]

    def advance(self, lang: str, vocab: pa.Array, ids: np.ndarray, words: int):
        """(number of words, positions, numbers of the phrases that begin there) for each level up to ``words``."""
        if lang not in self.langs:
            return
        root = self.base[0] + self.langs[lang]
        symbols = pc.fill_null(pc.index_in(vocab, self.words), -1).to_numpy().astype(np.int32)
        symbols = np.concatenate([symbols, [np.int32(-1)]])[np.concatenate([ids, np.full(words, -1, np.int32)])]
        at = np.flatnonzero(symbols[: len(ids)] >= 0)
        states = np.full(len(at), root, np.int32)
        for k in range(words):
            word = symbols[at + k]
            if k:
                some = np.flatnonzero(word >= 0)
                at, states, word = at[some], states[some], word[some]
            kept, states = self.step(states, word // self.width)
            at, word = at[kept], word[kept]
            kept, states = self.step(states, word % self.width)
            at = at[kept]
            found = self.accept[states]
            some = np.flatnonzero(found >= 0)
            yield k + 1, at[some], found[some]


def _build(group: pa.Table) -> pa.Table:
    group = group.sort_by("no")
    trie = Trie(group["lang"].to_pylist(), group["phrase"].cast(pa.binary()).combine_chunks())
    one = pa.ListArray.from_arrays
    return pa.table({
        "shard": group["shard"].slice(0, 1), "langs": [sorted(trie.langs)], "words": one(pa.array([0, len(trie.words)], pa.int32()), trie.words),
        "base": [trie.base.tobytes()], "check": [trie.check.tobytes()], "accept": [trie.accept.tobytes()]})


def count(stored: DataFrame, phrases: DataFrame, words: int, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of distinct ``lang, phrase`` rows, and ``block, bits`` that mark where those of ``words`` words begin."""
    spark = stored.sparkSession
    shards = max(1, -(-phrases.count() // shard))
    dealt = phrases.select(F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)).cast("int").alias("shard"), "lang", "phrase")
    order = Window.partitionBy("shard").orderBy("lang", "phrase")
    dealt = save(dealt.withColumn("no", F.row_number().over(order) - 1), "phrases")
    built = save(dealt.groupBy("shard").applyInArrow(_build, "shard int, langs array<string>, words array<binary>, base binary, check binary, accept binary"), "tries")
    counts, marks = None, None
    for s in range(shards):
        rows = built.where(F.col("shard") == s).toArrow()
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast(Trie.load(rows))

        def run(batches, shared=shared):
            trie = shared.value
            total = np.zeros(int(trie.accept.max(initial=-1)) + 1, np.int64)
            for batch in batches:
                for i, lang, vocab, ids in _block_rows(batch):
                    bits = np.zeros(len(ids), bool)
                    for level, at, found in trie.advance(lang, vocab, ids, words):
                        total += np.bincount(found, minlength=len(total))
                        if level == words:
                            bits[at] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None], pa.int32()), pa.array([None], pa.int64()), batch.column(0).slice(i, 1), pa.array([np.packbits(bits).tobytes()], pa.binary())],
                        ["no", "f", "block", "bits"])
            no = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(no.astype(np.int32)), pa.array(total[no]), pa.nulls(len(no), pa.int64()), pa.nulls(len(no), pa.binary())], ["no", "f", "block", "bits"])

        found = save(stored.mapInArrow(run, "no int, f long, block long, bits binary"), "counts")
        shared.destroy()
        mine = found.where("no is not null").groupBy(F.lit(s).alias("shard"), "no").agg(F.sum("f").alias("f"))
        here = found.where("block is not null").select("block", "bits")
        counts, marks = (mine, here) if counts is None else (counts.union(mine), marks.union(here))
    if counts is None:  # no phrases
        return phrases.select("lang", "phrase", F.lit(0).cast("long").alias("f")).limit(0), stored.select("block", F.col("ids").alias("bits")).limit(0)
    return save(dealt.join(counts, ["shard", "no"]).select("lang", "phrase", "f"), "sums"), marks


def collocations(docs: DataFrame, least: int = MIN_COUNT, words: int = MAX_WORDS, cover: int = 50, top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Phrases have 2 to ``words`` words and occur ``least`` times or more (``a``).
    ``l`` and ``r`` count the two parts of the cut with the lowest score, floor
    of 1,000,000 a a / (l r), computed in decimals: exact while a stays below
    10 ** 16. A phrase inside a longer one that has ``cover`` percent of its
    occurrences is left out. Null texts have no words, a null language is
    ``und``; each row of ``docs`` counts, repeated ones too. Words are compared
    byte by byte.
    """
    stored = blocks(docs, block)
    level = pairs(stored, least)
    single = level.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    counts, marks = count(stored, single.union(level), 2, shard)
    for k in range(3, words + 1):
        level = longer(stored, marks, k, least)
        more, marks = count(stored, level, k, shard)
        counts = counts.union(more)
    return rank(counts, stored.groupBy("lang").agg(F.sum("words").alias("n")), cover, top)


def rank(counts: DataFrame, sizes: DataFrame, cover: int = 50, top: int = TOP) -> DataFrame:
    """``collocations`` from ``lang, phrase, f`` of all candidates and their parts, and ``lang, n``."""
    w = F.split("phrase", " ")
    found = counts.where(F.size(w) > 1).select("lang", "phrase", F.col("f").alias("a"), w.alias("w"))
    cut = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("right"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    a, l, r = (F.col(c).cast("decimal(20,0)") for c in "alr")
    scored = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    scored = scored.select("lang", "phrase", "a", "k", "l", "r", (a * a * F.lit(1_000_000).cast("decimal(7,0)")).alias("_up"), (l * r).alias("_down"))
    scored = scored.select("lang", "phrase", "a", F.struct(F.expr("_up div _down").alias("score"), "k", "l", "r").alias("best"))
    scored = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("best").alias("best"))
    spans = "flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    inner = found.where(F.size("w") > 2).select("lang", F.explode(F.expr(spans)).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < cover * F.col("a"), F.lit(True)))
    order = [F.col("best.score").desc(), F.col("a").desc(), "phrase"]
    # First the best of each of 256 parts of a language, so that no task sorts a whole language.
    part = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", F.col("best.score").alias("score"))
