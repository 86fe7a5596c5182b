"""Block trees of HTML pages and their alignment by simple tree matching."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANKS = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas textarea title select".split())
#: Of these, what takes the rest of the page if it never ends.
SWALLOWING = frozenset("script style title textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup "
    "mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml"
    .split())
#: Elements that are no part of the main text.
DROPPED = frozenset("nav footer aside form button dialog menu head fieldset".split())
#: Whole classes, ids and roles that tell the same.
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social comment comments reply replies respond disqus breadcrumb breadcrumbs related recommended pagination pager widget "
    "toolbar search complementary contentinfo".split())
MAIN = frozenset(("article", "main"))
#: An open element of the second kind ends before a start tag of the first.
CLOSES = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
    "tbody": frozenset(("thead", "tbody", "tr", "td", "th")),
}
#: Where the search for an element to end stops.
SCOPES = frozenset("ul ol dl table article section div body nav main aside footer header".split())


class Page:
    """Block elements of a page in order, and its text blocks.

    Inline elements are no nodes; their text belongs to the block around them. A
    text block is (node, run within the node, text, dropped, in main, share of it in links).

    What looks like boilerplate drops what it holds, but not the page's article: if
    every marked article is in such elements, those that hold one drop nothing. A
    form around most of a page without a marked article drops nothing either.
    """

    def __init__(self, html: str):
        self.tags: list[str] = ["#page"]
        self.kids: list[list[int]] = [[]]
        self.blocks: list[tuple[int, int, str, bool, bool, float]] = []
        self.has_main = False
        self._read(html)

    def _read(self, html: str) -> None:
        # Open elements: tag, node (-1: inline), innermost element that drops it (-1: none), in main.
        stack: list[tuple[str, int, int, bool]] = [("#page", 0, -1, False)]
        droppers: list[tuple[int, bool]] = []  # the one around it, is a form
        mains: list[int] = []
        open_tags: dict[str, int] = {}
        runs, endless = [0], set()
        pieces: list[str] = []
        linked = links = 0
        node, at = 0, 0

        def flush():
            nonlocal pieces, linked
            if pieces:
                text = _BLANKS.sub(" ", unescape("".join(pieces))).strip()
                if text:
                    _, _, dropped, main = stack[-1]
                    self.blocks.append((node, runs[node], text, dropped, main, linked / max(1, sum(map(len, pieces)))))
                    runs[node] += 1
                pieces, linked = [], 0

        def close():
            nonlocal node, links
            tag, was, dropped, _ = stack[-1]
            if was >= 0 or dropped != stack[-2][2]:
                flush()
            stack.pop()
            open_tags[tag] -= 1
            links -= tag == "a"
            if was >= 0:
                node = next(s[1] for s in reversed(stack) if s[1] >= 0)

        pos = 0
        for m in _TOKEN.finditer(html):
            at = m.start()
            if at < pos:
                continue
            if at > pos:
                part = html[pos:at]
                pieces.append(part)
                if links:
                    linked += len(part)
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            tag, closing = name.lower(), m[1] or m[4]
            if closing:
                if tag == "br":
                    pieces.append(" ")
                elif open_tags.get(tag):
                    while stack[-1][0] != tag:
                        close()
                    close()
                elif tag == "p":
                    flush()
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in RAW:
                end = None if tag in endless else re.compile(rf"</{tag}\b[^<>]*>", re.I).search(html, pos)
                if end is None:
                    endless.add(tag)
                if end or tag in SWALLOWING:
                    pos = end.end() if end else len(html)
                if tag not in INLINE:
                    pieces.append(" ")
                continue
            inline = tag in INLINE
            if not inline:
                if open_tags.get("p"):
                    while open_tags.get("p"):
                        close()
                ends = CLOSES.get(tag)
                if ends:
                    for s in range(len(stack) - 1, 0, -1):
                        if stack[s][0] in ends:
                            while len(stack) > s:
                                close()
                        elif stack[s][0] in SCOPES:
                            break
                flush()
            if tag in VOID:
                continue
            _, _, dropped, main = stack[-1]
            more = m[3] or m[6] or ""
            role = _role(tag, more, main) if more.strip() or not inline else 0
            if role < 0:
                droppers.append((dropped, tag == "form"))
                dropped = len(droppers) - 1
            if role > 0:
                main = True
                mains.append(dropped)
            if inline:
                if dropped != stack[-1][2]:
                    flush()
                stack.append((tag, -1, dropped, main))
            else:
                self.tags.append(tag)
                self.kids.append([])
                runs.append(0)
                self.kids[node].append(len(self.tags) - 1)
                node = len(self.tags) - 1
                stack.append((tag, node, dropped, main))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            links += tag == "a"
        if pos < len(html):
            pieces.append(html[pos:])
        flush()
        self.has_main = bool(mains)
        self._drop(droppers, mains)

    def _drop(self, droppers: list[tuple[int, bool]], mains: list[int]) -> None:
        """Replaces each block's innermost dropping element by whether the block is dropped."""
        active = [True] * len(droppers)
        if mains and -1 not in mains:
            for at in mains:
                while at >= 0 and active[at]:
                    active[at] = False
                    at = droppers[at][0]
        # The one element that drops what is in each (-1: none, -2: several).
        by = []
        for (around, _), on in zip(droppers, active, strict=True):
            outer = by[around] if around >= 0 else -1
            by.append(outer if not on else len(by) if outer == -1 else -2)
        free = -1
        if not mains and any(form for _, form in droppers):
            sizes: dict[int, int] = {}
            for _, _, text, at, _, _ in self.blocks:
                only = by[at] if at >= 0 else -1
                sizes[only] = sizes.get(only, 0) + len(text)
            forms = [at for at in sizes if at >= 0 and droppers[at][1]]
            largest = max(forms, key=sizes.__getitem__, default=-1)
            if largest >= 0 and sizes[largest] > sizes.get(-1, 0):
                free = largest
        self.blocks = [
            (node, run, text, at >= 0 and by[at] != -1 and (free < 0 or by[at] != free), main, linked)
            for node, run, text, at, main, linked in self.blocks]

    def skeleton(self) -> str:
        """Tags with the number of their parent, in page order; what ``Tree`` reads."""
        parent = [0] * len(self.tags)
        for i, kids in enumerate(self.kids):
            for k in kids:
                parent[k] = i
        return " ".join(f"{t}:{p}" for t, p in zip(self.tags, parent, strict=True))


def _role(tag: str, attributes: str, in_main: bool) -> int:
    """-1: boilerplate; 1: main text; 0: as what is around it. The page's body and its article are never boilerplate."""
    drop = tag in DROPPED or (tag == "header" and not in_main)
    role = 1 if tag in MAIN else 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            words = set(value.split())
            drop = drop or bool(words & DROPPED_WORDS) or ("header" in words and not in_main)
            if name == "role" and words & MAIN:
                role = 1
        elif name == "itemprop" and value == "articlebody":
            role = 1
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            drop = True
    if drop and tag not in ("html", "body") and not (role and not in_main):
        return -1
    return role


class Tree:
    """Tags and children read from a skeleton."""

    def __init__(self, skeleton: str):
        parts = [p.rsplit(":", 1) for p in skeleton.split(" ")]
        self.tags = [p[0] for p in parts]
        self.kids: list[list[int]] = [[] for _ in parts]
        for i, (_, parent) in enumerate(parts[1:], 1):
            self.kids[int(parent)].append(i)


class _Shapes:
    """Subtrees of two trees by number: equal subtrees have one number, whichever tree they are in."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []

    def of(self, tree) -> list[int]:
        out = [0] * len(tree.tags)
        for i in range(len(out) - 1, -1, -1):  # children come after their parents
            kids = tuple(out[k] for k in tree.kids[i])
            shape = (tree.tags[i], kids)
            if shape not in self.known:
                self.known[shape] = len(self.tag)
                self.tag.append(tree.tags[i])
                self.kids.append(kids)
                self.size.append(1 + sum(self.size[k] for k in kids))
            out[i] = self.known[shape]
        return out

    def ends(self, left, right) -> tuple[int, int]:
        """How many equal subtrees two child lists begin and end with; to match these is a best choice.

        Leaves at both ends go first, then other subtrees from the end, then from the start.
        """
        n = min(len(left), len(right))
        lo = hi = 0
        while lo < n and left[lo] == right[lo] and not self.kids[left[lo]]:
            lo += 1
        while hi < n - lo and left[-1 - hi] == right[-1 - hi]:
            hi += 1
        while lo < n - hi and left[lo] == right[lo]:
            lo += 1
        return lo, hi


#: Cells of a table that is kept whole; a larger one is halved, so that only rows are held.
_CELLS = 1 << 20
#: Tables so small that plain loops are quicker.
_SHORT = 400


def _last_row(weight: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Most matched nodes of all ``xs`` with the first ``0, 1, ...`` of ``ys``; ``weight`` is by distinct shape."""
    best = np.zeros(len(ys) + 1, np.int64)
    for x in xs:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weight[x][ys]))
    return best


def _matches(weight: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
    """Places of ``xs`` and ``ys`` that are matched, in linear memory."""
    out, todo = [], [(0, len(xs), 0, len(ys))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > _CELLS and b - a > 1:
            mid = (a + b) // 2
            before = _last_row(weight, xs[a:mid], ys[c:d])
            after = _last_row(weight, xs[mid:b][::-1], ys[c:d][::-1])[::-1]
            cut = c + int((before + after).argmax())
            todo += [(a, mid, c, cut), (mid, b, cut, d)]
            continue
        best = np.zeros((b - a + 1, d - c + 1), np.int64)
        for i in range(a, b):
            row = np.maximum(best[i - a, 1:], best[i - a, :-1] + weight[xs[i]][ys[c:d]])
            best[i - a + 1, 1:] = np.maximum.accumulate(row)
        i, j = b - a, d - c
        while i and j:
            w = weight[xs[a + i - 1], ys[c + j - 1]]
            if w and best[i, j] == best[i - 1, j - 1] + w:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
    return out


def _few(xs, ys, weigh) -> tuple[int, list[tuple[int, int]]]:
    """Matched nodes and matches of two short lists of shapes."""
    weight = [[weigh(x, y) for y in ys] for x in xs]
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, w in enumerate(weight):
        row, above = best[i + 1], best[i]
        for j in range(len(ys)):
            row[j + 1] = max(above[j + 1], row[j], above[j] + w[j])
    out, i, j = [], len(xs), len(ys)
    while i and j:
        if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], out


def align(page, seed) -> dict[int, int]:
    """Nodes of ``page`` to nodes of ``seed`` by simple tree matching.

    Two nodes match if their tags are equal; among the children, matches keep
    their order and the number of matched nodes is greatest. Equal subtrees at
    the ends of two child lists are matched at once, as no other choice gives
    more. What is left is weighed once for each two different shapes, however
    often they stand in the lists, and aligned row by row in linear memory.
    Pairs wait on a list for those below them, so trees may be of any depth.
    """
    shapes = _Shapes()
    left_of, right_of = shapes.of(page), shapes.of(seed)
    memo: dict[tuple[int, int], int] = {}

    def weights(xs, ys):
        """Distinct shapes' weights, and the lists as numbers of distinct shapes."""
        a, at_x = np.unique(np.array(xs, np.int64), return_inverse=True)
        b, at_y = np.unique(np.array(ys, np.int64), return_inverse=True)
        return np.array([[weigh(x, y) for y in b.tolist()] for x in a.tolist()], np.int64).reshape(len(a), len(b)), at_x, at_y

    def weigh(x, y):
        if shapes.tag[x] != shapes.tag[y]:
            return 0
        if x == y:
            return shapes.size[x]
        return memo[x, y]

    def middle(x, y):
        left, right = shapes.kids[x], shapes.kids[y]
        lo, hi = shapes.ends(left, right)
        return left[lo : len(left) - hi], right[lo : len(right) - hi], lo, hi

    def fill(x, y):
        todo = [(x, y)]
        while todo:
            at = todo[-1]
            if at in memo:
                todo.pop()
                continue
            xs, ys, lo, hi = middle(*at)
            below = [(a, b) for a in set(xs) for b in set(ys) if a != b and shapes.tag[a] == shapes.tag[b] and (a, b) not in memo]
            if below:
                todo += below
                continue
            kids = shapes.kids[at[0]]
            size = 1 + sum(shapes.size[k] for k in kids[:lo]) + sum(shapes.size[k] for k in kids[len(kids) - hi :])
            if xs and ys:
                if len(xs) * len(ys) <= _SHORT:
                    size += _few(xs, ys, weigh)[0]
                else:
                    table, at_x, at_y = weights(xs, ys)
                    size += int(_last_row(table, at_x, at_y)[-1])
            memo[at] = size
            todo.pop()

    out, stack = {}, [(0, 0)]
    while stack:
        x, y = stack.pop()
        out[x] = y
        left, right = page.kids[x], seed.kids[y]
        if left_of[x] == right_of[y]:
            stack += zip(left, right, strict=True)
            continue
        fill(left_of[x], right_of[y])
        xs, ys, lo, hi = middle(left_of[x], right_of[y])
        stack += zip(left[:lo], right[:lo], strict=True)
        stack += zip(left[len(left) - hi :], right[len(right) - hi :], strict=True)
        if xs and ys:
            if len(xs) * len(ys) <= _SHORT:
                found = _few(xs, ys, weigh)[1]
            else:
                found = _matches(*weights(xs, ys))
            stack += [(left[lo + i], right[lo + j]) for i, j in found]
    return out
