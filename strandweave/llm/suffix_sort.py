"""Deep-shallow sorting of byte strings, and which windows of marked strings repeat."""

from __future__ import annotations

import numpy as np

SHALLOW = 48


class BlindTrie:
    """Trie that keeps only branching positions; equal strings share a leaf.

    An insertion walks down by the branching bytes alone, compares the string
    with the one leaf it meets, and branches where the two first differ.
    """

    def __init__(self, rows: list[bytes]):
        self.rows = rows
        self.root: list | None = None  # leaf: [None, member, ...]; inner node: [position, {byte: node}]

    def insert(self, member: int) -> None:
        text = self.rows[member]
        if self.root is None:
            self.root = [None, member]
            return
        node = self.root
        while node[0] is not None:
            kids = node[1]
            node = kids.get(text[node[0]]) or next(iter(kids.values()))
        other = self.rows[node[1]]
        if other == text:
            node.append(member)
            return
        differ = int.from_bytes(text) ^ int.from_bytes(other)
        at = len(text) - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] is not None and node[0] < at:
            above, node = node, node[1][text[node[0]]]
        if node[0] == at:
            node[1][text[at]] = [None, member]
            return
        inner = [at, {other[at]: node, text[at]: [None, member]}]
        if above is None:
            self.root = inner
        else:
            above[1][text[above[0]]] = inner

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[1:]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def sort_rows(matrix: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows of a byte matrix.

    Shallow: multikey sorting by eight bytes at a time, where only groups of rows
    that are equal so far are sorted on. Deep: what is still equal after
    ``shallow`` bytes is put in order by a blind trie for each group.
    """
    n, width = matrix.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = matrix
    words = padded.view(">u8")
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # by place in the order
    open_places = np.arange(n)
    for depth in range(min(words.shape[1], max(1, shallow // 8))):
        if len(open_places) < 2:
            break
        rows = order[open_places]
        key = words[rows, depth].astype(np.uint64)
        by = np.lexsort((key, group[open_places]))
        order[open_places] = rows[by]
        key, old = key[by], group[open_places]  # groups are contiguous, so sorting keeps them in place
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])])
        group[open_places] = open_places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(new)]]))
        open_places = open_places[np.repeat(size > 1, size)]
    if len(open_places) and words.shape[1] * 8 > shallow:
        ids = group[open_places]
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            places = open_places[a:b]
            trie = BlindTrie([matrix[r].tobytes() for r in order[places]])
            for i in range(b - a):
                trie.insert(i)
            order[places] = order[places][trie.order()]
    return order


def shared_prefix(matrix: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in the order how many bytes its row shares with the row before (the first: 0)."""
    rows = matrix[order]
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    short = np.minimum(lengths[order][1:], lengths[order][:-1])
    return np.concatenate([[0], np.minimum(first, short)])


def classes(matrix: np.ndarray, lengths: np.ndarray):
    """Function of a depth: numbers by row, equal for rows whose first ``depth`` bytes are equal."""
    # Rows are padded with zero bytes. Of rows that look equal the shorter ones come first, so none stands between two longer ones.
    by_length = np.argsort(lengths, kind="stable")
    order = by_length[sort_rows(matrix[by_length])]
    shared = shared_prefix(matrix, lengths, order)
    out = np.empty(len(order), np.int64)

    def of(depth: int) -> np.ndarray:
        out[order] = np.cumsum(shared < depth)
        return out

    return of


def repeated_windows(segments: list[bytes], anchors: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment which of its windows of ``width`` bytes are in another segment, too.

    A segment is a run of windows that all hold the byte at ``anchors[i]`` of it;
    equal windows hold their anchors at the same place, and no two segments are
    equal with the same anchor. Segments are sorted twice from the anchor, on to the
    right and back to the left; a window that reaches ``d`` bytes to the left
    repeats if another segment equals it in the next ``width - d`` bytes and in
    the ``d`` bytes before.
    """
    n = len(segments)
    sizes = np.fromiter(map(len, segments), np.int64, n)
    anchors = np.asarray(anchors, np.int64)
    right, left = np.zeros((n, width), np.uint8), np.zeros((n, width), np.uint8)
    for i, text in enumerate(segments):
        data = np.frombuffer(text, np.uint8)
        part = data[anchors[i] : anchors[i] + width]
        right[i, : len(part)] = part
        part = data[: anchors[i]][::-1][:width]
        left[i, : len(part)] = part
    by_right, by_left = classes(right, sizes - anchors), classes(left, anchors)
    lowest = np.maximum(0, anchors - (sizes - width))  # bytes before the anchor in the last and the first window
    ends = np.cumsum(sizes - width + 1)
    begins = ends - (sizes - width + 1)
    out = np.zeros(int(ends[-1]) if n else 0, bool)
    for d in range(int(lowest.min(initial=0)), int(anchors.max(initial=-1)) + 1):
        rows = np.flatnonzero((lowest <= d) & (d <= anchors))
        if len(rows) < 2:
            continue
        key = by_right(width - d)[rows] * (n + 1) + by_left(d)[rows]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twin = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        hit = rows[by[twin]]
        out[begins[hit] + anchors[hit] - d] = True
    return [out[a:b] for a, b in zip(begins, ends, strict=True)]
