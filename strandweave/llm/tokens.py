"""Exact byte-level BPE ids, with each distinct stretch of text encoded once per worker."""

from __future__ import annotations

import re
from array import array

import numpy as np

#: A pre-token of Latin letters, then one of ASCII marks (the apostrophe may begin a contraction).
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in keep else next(rest)) for b in range(256)}


class _Units(dict):
    """Unit -> number, filled on first use."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, unit):
        self[unit] = at = self.add(unit)
        return at


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library.

    The pre-tokenizer of the byte-level models never joins text across a single
    space between two non-blank characters, nor across a single newline between
    them. Texts are cut there, and each distinct piece is encoded by the library
    once; texts with other white space are cut only where that rule holds. Ids
    equal those of encoding the text at once, with the tokenizer's added tokens
    found as the library finds them: texts are first split at their contents. The
    cache is emptied beyond ``limit`` pieces, so memory is bounded; that changes no id.
    """

    def __init__(self, path: str, limit: int = 900_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        added = self.whole.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        #: Added tokens that look at the text around them leave a text to the library as it is.
        self.apart = not any(t.lstrip or t.rstrip or t.single_word or t.normalized or t.content != t.content.strip() for t in added.values())
        #: The library takes the leftmost added token, of several there the longest.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.alphabet = byte_alphabet()
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.units, self.exact, self.marks = _Units(self._add_unit), _Units(self._add), {}
        self.tokens: dict[str, int] = {}
        self.flat, self.starts, self.counts = array("I"), array("q"), array("q")

    def _bpe(self, text: str) -> list[int]:
        mapped = text.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(mapped)]

    def _add(self, text: str) -> int:
        m = _PLAIN.fullmatch(text)
        if m is None:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            lead, word, marks = m.groups()
            ids = self._mark(lead) + self._bpe(word) if lead == "\n" else self._bpe(lead + word)
            if marks:
                ids = ids + self._mark(marks)
        return self._put(ids)

    def _put(self, ids: list[int]) -> int:
        self.starts.append(len(self.flat))
        self.counts.append(len(ids))
        self.flat.extend(ids)
        return len(self.starts) - 1

    def _mark(self, text: str) -> list[int]:
        ids = self.marks.get(text)
        if ids is None:
            ids = self.marks[text] = self._bpe(text)
        return ids

    def _add_unit(self, unit: str) -> int:
        """A unit stands for itself after a newline and for space + unit else; -1: it holds other white space."""
        body = unit[1:] if unit[:1] == "\n" else unit
        if body.split() != [body]:
            return -1
        return self._add(unit if body is not unit and unit[:1] == "\n" else " " + unit)

    def _numbers(self, text: str) -> tuple[np.ndarray, int]:
        """Piece numbers of one text and how many leading ids are not its own."""
        if not text:
            return np.empty(0, np.int64), 0
        units = ("\n" + text).replace("\n", " \n").split(" ")
        del units[0]
        at = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        if at.min() >= 0:
            return at, 1  # the added newline is the one-id first piece of the first unit
        pieces = _SINGLE_SPACE.split(text)
        pieces[1:] = [" " + p for p in pieces[1:]]
        return np.fromiter(map(self.exact.__getitem__, pieces), np.int64, len(pieces)), 0

    def _parts(self, text: str) -> list[tuple[np.ndarray, int]]:
        """``_numbers`` of the stretches between added tokens, and these as pieces of one id."""
        if not any(content in text for content in self.added):
            return [self._numbers(text)]
        if not self.apart:
            return [(np.array([self._put(self.whole.encode(text, add_special_tokens=False).ids)]), 0)]
        out = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2 == 0:
                out.append(self._numbers(part))
            else:
                if part not in self.tokens:
                    self.tokens[part] = self._put([self.added[part]])
                out.append((np.array([self.tokens[part]]), 0))
        return out

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32) and where each text begins (one more entry: the end)."""
        if max(len(self.units) + len(self.exact), len(self.flat) // 16) > self.limit:
            self.clear()
        numbers, skip, sizes, heads = [], [], [], [0]
        for text in texts:
            for at, lead in self._parts(text or ""):
                numbers.append(at)
                skip.append(lead)
                sizes.append(len(at))
            heads.append(len(sizes))
        flat = np.array(self.flat, np.uint32)
        starts, counts = np.array(self.starts, np.int64), np.array(self.counts, np.int64)
        at = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n, begin = counts[at], starts[at]
        lead = np.array(skip, np.int64)
        has = lead > 0
        n[first[:-1][has]] -= 1
        begin[first[:-1][has]] += 1
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin - ends + n, n) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[first][heads]
        if end is None:
            return ids, bounds
        out = np.full(total + len(texts), end, np.uint32)
        lengths = np.diff(bounds)
        keep = np.ones(len(out), bool)
        keep[bounds[1:] + np.arange(len(texts))] = False
        out[keep] = ids
        return out, np.concatenate([[0], np.cumsum(lengths + 1)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: list[str | None], chars: int = 2_000_000):
    """Runs of neighbouring texts of about ``chars`` characters: (first, last + 1)."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
