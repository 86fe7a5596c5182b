"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. Each host has two reference pages, those of
least and of greatest hash; every page's tree is aligned with theirs by simple
tree matching, which puts each text block into a slot of the reference. A text
that stands in the same slot on most pages that have it is template; a slot whose
text varies is content. Elements that say what they are (menus, footers, forms,
adverts, comments and the like) by their tag or by a whole class, id or role are
left out beforehand, and where a page marks its article, only that is looked at.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import save
from strandweave.llm.html_tree import Page, Tree, align
from strandweave.llm.url_filter import host_of

#: A text is template if it is in its slot on this share of the host's different pages that have the slot, and on this many.
SHARE = 0.5
LEAST = 3
#: Pages that have this share of their characters in common are near copies.
AGREE = 0.75
#: On hosts of too few pages for a template, list items outside an article of which this share is link text are menus.
LINKS = 0.8
_RUNS = 1000


def candidates(page: Page, menus: bool = True) -> list[tuple[int, int, str]]:
    """Blocks that may be main text: ``(node, run, text)``; without ``menus`` no list items of links."""
    out = []
    for node, run, text, dropped, main, linked in page.blocks:
        if dropped or (page.has_main and not main) or (not menus and not main and linked >= LINKS and page.tags[node] == "li"):
            continue
        out.append((node, run, text))
    return out


def _slots(page: Page, blocks, tree: Tree) -> list[int]:
    """Slot of each block in a reference tree; -1: its node has no partner there."""
    found = align(page, tree)
    return [found[n] * _RUNS + min(r, _RUNS - 1) if n in found else -1 for n, r, _ in blocks]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def extract(html: str | None, trees: list[Tree], template: set[tuple[int, int, int]], judged: bool = False) -> str:
    """Main text of one page; ``template`` has (reference, slot, text hash).

    Where the host's pages have been ``judged``, the template alone tells which links are menus.
    """
    page = Page(html or "")
    blocks = candidates(page, menus=judged)
    if template and blocks:
        keep = [True] * len(blocks)
        hashes = [_hash(t) for _, _, t in blocks]
        for which, tree in enumerate(trees):
            for i, slot in enumerate(_slots(page, blocks, tree)):
                if slot >= 0 and (which, slot, hashes[i]) in template:
                    keep[i] = False
        blocks = [b for b, k in zip(blocks, keep, strict=True) if k]
    return "\n\n".join(text for _, _, text in blocks)


def references(rows: DataFrame) -> DataFrame:
    """Per host the skeletons of its two reference pages: ``host, skeletons, pages``."""
    ends = rows.groupBy("host").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count(F.lit(1)).alias("pages"))
    ends = save(ends.where(F.col("pages") >= LEAST), "hosts")
    chosen = rows.join(ends, "host").where("h = low or h = high").select("host", "h", "low", "pages", "html")
    # Equal pages have equal hashes and one skeleton.
    chosen = chosen.dropDuplicates(["host", "h"])

    def run(batches):
        for batch in batches:
            table = [Page(t or "").skeleton() for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(table, pa.string())], ["host", "h", "low", "pages", "skeleton"])

    trees = chosen.mapInArrow(run, "host string, h long, low long, pages long, skeleton string")
    order = F.array_sort(F.collect_list(F.struct((F.col("h") != F.col("low")).alias("second"), "skeleton")))
    return save(trees.groupBy("host").agg(F.max("pages").alias("pages"), order.getField("skeleton").alias("skeletons")), "references")


def _weights(blocks: DataFrame) -> DataFrame:
    """Per page of ``host, h, text, size`` (one row per text): ``host, h, weight``.

    If ``AGREE`` of a page's characters are in texts that c pages or more of the
    host have, the page is taken for one of c near copies and counts 1/c.
    """
    shared = blocks.groupBy("host", "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = blocks.join(shared, ["host", "text"], "left")
    copies = F.expr(f"percentile(coalesce(n, 1), {1 - AGREE}, size)")
    return save(counted.groupBy("host", "h").agg((1 / copies).alias("weight")), "weights")


def templates(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Per host with pages enough: ``host, skeletons, slots``; a slot is (reference, slot, text hash).

    Each different page votes once, near copies of one page together once. A slot
    has at most two texts that are on half of its pages, so a host's list is bounded
    by its reference pages.
    """

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            trees: dict[str, list[Tree]] = {}
            for host, h, html, skeletons in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if host not in trees:
                    trees[host] = [Tree(s) for s in skeletons]
                page = Page(html or "")
                blocks = candidates(page)
                hashes = [_hash(t) for _, _, t in blocks]
                sizes = defaultdict(int)
                for (_, _, text), mark in zip(blocks, hashes, strict=True):
                    sizes[mark] += len(text)
                found = {(-1, -1, mark): n for mark, n in sizes.items()}  # the page's texts, wherever they stand
                for which, tree in enumerate(trees[host]):
                    found |= {(which, slot, mark): 0 for slot, mark in zip(_slots(page, blocks, tree), hashes, strict=True) if slot >= 0}
                for (which, slot, mark), n in found.items():
                    for column, value in zip(out, (host, which, slot, mark, h, n), strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["host", "which", "slot", "text", "h", "size"])

    seen = rows.select("host", "h", "html").join(refs.select("host", "skeletons"), "host")
    seen = save(seen.mapInArrow(run, "host string, which int, slot long, text long, h long, size long").distinct(), "seen")
    weights = _weights(seen.where("which < 0").select("host", "h", "text", "size"))
    pages = weights.groupBy("host").agg(F.sum("weight").alias("pages"))
    votes = seen.where("which >= 0").join(weights, ["host", "h"])
    texts = votes.groupBy("host", "which", "slot", "text").agg(F.sum("weight").alias("n"))
    texts = texts.where(F.col("n") > LEAST - 1e-6)
    there = votes.groupBy("host", "which", "slot").agg(F.sum("weight").alias("there"))
    common = texts.join(there, ["host", "which", "slot"]).where(F.col("n") > F.col("there") * F.lit(SHARE) - 1e-6)
    slots = common.groupBy("host").agg(F.collect_list(F.struct("which", "slot", "text")).alias("slots"))
    judged = pages.where(F.col("pages") > LEAST - 1e-6).select("host").join(refs.select("host", "skeletons"), "host")
    return save(judged.join(slots, "host", "left").select("host", "skeletons", F.coalesce("slots", F.array()).alias("slots")), "templates")


def main_text(pages: DataFrame) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``.

    Blocks are joined by two newlines; white space in a block is one space,
    character references are decoded. A null or empty page has the empty text. A
    null or odd URL has the empty host, whose pages are taken as one host's.
    Repeated rows give repeated rows; null ids stay null.
    """
    rows = pages.select(F.col("page_id"), F.col("url"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("h", F.xxhash64("html"))
    refs = references(rows.select("host", "h", "html"))
    found = templates(rows, refs)
    # Small beside the pages: read from storage, so Spark knows its size and need not move the pages.
    joined = rows.select("page_id", "url", "host", "html").join(found, "host", "left")

    def run(batches):
        known: dict[str, tuple[list[Tree], set, bool]] = {}
        for batch in batches:
            texts = []
            hosts, htmls, skeletons, slots = (batch.column(i) for i in (0, 3, 4, 5))
            for i, (host, html) in enumerate(zip(hosts.to_pylist(), htmls.to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    trees = [Tree(s) for s in skeletons[i].as_py() or ()]
                    known[host] = trees, {(s["which"], s["slot"], s["text"]) for s in slots[i].as_py() or ()}, slots[i].is_valid
                texts.append(extract(html, *known[host]))
            sizes = pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    joined = joined.select("host", "page_id", "url", "html", "skeletons", "slots")
    ids = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {ids}, url string, text string, n_chars long")
