"""Benchmark decontamination by the q-gram lemma.

A document holds a benchmark item if some region of it is within ``k`` edits of the whole item,
where ``k`` is a share of the item's length. Such a region shares at least ``L + 1 - q * (k + 1)``
of the item's q-grams with it, on neighbouring diagonals. So the shared q-grams of a document
and an item are counted in bands of ``2 * (k + 1)`` diagonals, each overlapping half of the
next, and only bands that meet the bound are verified, by alignment within the band. The lemma
loses nothing; the alignment decides.

Texts are compared by their lower-case letters and digits, any other run of characters being
one space. Items whose budget would leave no q-gram to share get the largest budget that does;
items shorter than ``q`` compared characters, and null ones, are never found, as they would
occur everywhere. Null documents hold nothing. Items with equal texts are found each. The
benchmark is sent to the tasks in blocks of bounded size. An empty benchmark or table finds
nothing. Input columns named ``leaks`` are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlytics.llm.helpers import word_codes

Q = 8
#: Edits allowed, as a share of the item's compared characters.
RATE = 0.1
#: Characters of benchmark text that are sent to a task at once.
BLOCK_CHARS = 8 << 20
BITS = 22

LEAK = "struct<item_id:long,start:long,stop:long,edits:long>"
LEAKS = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "stop", "edits")]))


def compared(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The compared characters and the place of each in the text."""
    codes = word_codes(text)
    space = codes == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    if len(at) and codes[at[0]] == 32:
        at = at[1:]
    if len(at) and codes[at[-1]] == 32:
        at = at[:-1]
    return codes[at], at


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the eight characters from each position on, by doubling."""
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for width, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (4, 0xD6E8FEB86659FD93)):
            if len(h) <= width:
                return h[:0]
            h = h[:-width] * np.uint64(factor) + h[width:]
            h ^= h >> np.uint64(29)
    return h


def budget(length: int, rate: float) -> int:
    return max(0, min(int(length * rate), (length - Q) // Q))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """Least edits from the item to a stretch of text, and the stretch's end, along diagonals
    (place in text less place in item) ``low`` to ``high``; None if above ``most``. The stretch
    starts anywhere or, if ``anchored``, at 0."""
    n, m, width = len(item), len(text), high - low + 1
    far = n + m + 1
    steps = np.arange(width, dtype=np.int32)
    place = steps + low  # place in text of each diagonal's cell, in row 0
    row = np.where((place < 0) | (place > m), far, place if anchored else 0).astype(np.int32)
    # Room for every diagonal in every row; what is not text differs from all characters.
    shift = max(0, -low)
    padded = np.full(shift + max(m, high + n) + 1, -1, np.int64)
    padded[shift:shift + m] = text
    differs = np.empty(width, np.int32)
    for i, c in enumerate(item.tolist()):
        at = low + i + shift  # the text characters that diagonal steps consume
        np.not_equal(padded[at:at + width], c, out=differs, casting="unsafe")
        differs += row
        np.minimum(differs[:-1], row[1:] + 1, out=differs[:-1])
        differs -= steps
        np.minimum.accumulate(differs, out=row)
        row += steps
        end = low + i + 1  # place in text after this row, of the first diagonal
        if end < 0:
            row[:-end] = far
        if end + width - 1 > m:
            row[max(0, m - end + 1):] = far
        if i % 8 == 7 and row.min() > most:
            return None
    best = int(row.argmin())
    return (int(row[best]), int(place[best]) + n) if row[best] <= most else None


class Items:
    """The q-grams of a block of items, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.ids, self.codes = [], []
        for item_id, text in items:
            codes = compared(text)[0]
            if len(codes) >= Q:
                self.ids.append(item_id)
                self.codes.append(codes)
        hashes = [gram_hashes(c) for c in self.codes]
        self.edits = np.array([budget(len(c), rate) for c in self.codes], np.int64)
        self.least = np.array([len(h) for h in hashes], np.int64) - Q * self.edits
        all_, owner = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(h)) for h in hashes]])
        order = np.argsort(all_, kind="stable")
        self.hash, self.item, self.place = all_[order], owner[order], place[order]
        # Of each hash in order, where the run of its equals ends.
        self.end = np.searchsorted(self.hash, self.hash, "right")
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(self.hash >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in it and diagonal of every q-gram shared with an item that shares enough."""
        h = gram_hashes(codes)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        h = h[at]
        low = np.searchsorted(self.hash, h)
        low[low == len(self.hash)] = 0
        same = self.hash[low] == h
        at, low = at[same], low[same]
        count = self.end[low] - low
        each = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, place = self.item[each], self.place[each]
        enough = np.bincount(item, minlength=len(self.ids)) >= self.least
        keep = np.flatnonzero(enough[item])
        return item[keep], place[keep], np.repeat(at, count)[keep] - place[keep]

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """Item, start, stop and edits of each region of the text that holds an item."""
        if not self.ids or not text:
            return []
        codes, at = compared(text)
        found = []
        item, place, diagonal = self.hits(codes)
        for x in np.flatnonzero(np.bincount(item, minlength=1)):
            mine = np.flatnonzero(item == x)
            mine = mine[np.argsort(diagonal[mine], kind="stable")]
            k, own, places = int(self.edits[x]), diagonal[mine], place[mine]
            length, width = len(self.codes[x]), k + 1
            band, count = np.unique(np.concatenate([own // width, own // width - 1]), return_counts=True)
            best: list[tuple[int, int, int]] = []
            for b in band[count >= self.least[x]]:
                region = self.verify(int(x), codes, own, places, int(b) * width, (int(b) + 2) * width - 1)
                if region:
                    best.append(region)
            # Overlapping bands tell of one region: the fewest edits win, then the first.
            taken: list[tuple[int, int, int]] = []
            for edits, start, stop in sorted(best):
                if not any(start < b and a < stop for _, a, b in taken):
                    taken.append((edits, start, stop))
            found += [(self.ids[x], int(at[a]), int(at[b - 1]) + 1, e) for e, a, b in taken]
        return sorted(found, key=lambda f: (f[1], f[2], f[0] is None, f[0] or 0))

    def verify(self, x: int, codes: np.ndarray, diagonals: np.ndarray, places: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        """Edits, start and stop of the best region along a band."""
        item, k, length = self.codes[x], int(self.edits[x]), len(self.codes[x])
        band = slice(np.searchsorted(diagonals, low), np.searchsorted(diagonals, high, "right"))
        mine, of = diagonals[band], places[band]
        # A repeated q-gram counts once, in the item and in the text.
        if min(len(np.unique(of)), len(np.unique(mine + of))) < self.least[x]:
            return None
        distinct, count = np.unique(mine, return_counts=True)
        for d in distinct[count == length - Q + 1]:
            if d >= 0 and np.array_equal(codes[d:d + length], item):
                return 0, int(d), int(d) + length
        base = max(0, low - k)
        text = codes[base:max(base, high + k + length)].astype(np.int64)
        ends = align(item, text, low - k - base, high + k - base, k)
        if ends is None or ends[1] <= 0:
            return None
        edits, stop = ends
        back = align(item[::-1], text[:stop][::-1], -k, k, k, anchored=True)
        if back is None or back[1] <= 0:
            return None
        return edits, base + stop - back[1], base + stop


def blocks(benchmark: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about ``chars`` characters, one at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    for i in range(n):
        yield [(r["id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()]


def _finder(block: Broadcast, rate: float):
    """A column function that scans texts for one block of items."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(block.value, rate)
        for texts in arrays:
            rows = ([dict(zip(("item_id", "start", "stop", "edits"), f, strict=True)) for f in items.find(t or "")] for t in texts.to_pylist())
            yield pa.array(rows, LEAKS)

    # Else a filter that the planner adds before an explode would scan the texts once more.
    return F.arrow_udf(run, f"array<{LEAK}>").asNondeterministic()


def mark_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``leaks``: item, start and stop (code points) and edits of each find. The
    texts are scanned where they lie; nothing is shuffled."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "leaks"]
    context = docs.sparkSession.sparkContext
    # One block holds at most about block_chars characters.
    parts = [_finder(context.broadcast(block), rate)(F.col(text_col)) for block in blocks(benchmark, item_col, item_text_col, block_chars)]
    return docs.select(*kept, (F.concat(*parts) if len(parts) > 1 else parts[0]).alias("leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **kind) -> DataFrame:
    """A row for each region of a document that holds an item: id, item, start, stop, edits."""
    marked = mark_leaks(docs, benchmark, **kind)
    return marked.select(F.col(id_col), F.explode("leaks").alias("x")).select(id_col, "x.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **kind) -> DataFrame:
    """The documents that hold no item, with their columns."""
    return mark_leaks(docs, benchmark, **kind).where(F.size("leaks") == 0).drop("leaks")
