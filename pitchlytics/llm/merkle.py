"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A paragraph is a line; a section ends at a blank line or at a paragraph whose own hash is a
multiple of ``SECTION``, so an edit moves no section border but its own. Within a paragraph,
pieces end at sentence ends, at certain ends of words and numbers or, in scripts beyond Latin, after certain
characters, so borders fall in step again after an edit; no piece is longer than two hex digits
can say. Every node's hash is that of its children's, under a tag of its level.

The fingerprint is text: the root, then the sections between ``/``, their paragraphs between
``;``, and each paragraph's pieces as eight hex digits of hash and two of length. Equal texts
have equal fingerprints, unequal ones unequal roots; ``edits`` descends only into branches whose
hashes differ and tells where the two texts part. ``likeness`` is the share of both texts outside
these stretches.

Null texts are empty and have the fingerprint of the empty text. Line ends and white space
count. A document's next is taken by descending id, null ids last, equal ids by a hash of their
text; after the last comes the first. An empty table gives an empty result. Other columns are
ignored. Very long texts are cut whole, in one task; comparing two takes time in proportion to
their pieces.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlytics.storage import settle

#: Every eighth character from Greek on ends a piece.
_BORDERS = "".join(chr(c) for c in range(0x0370, 0xFFFF, 8) if not 0xD800 <= c <= 0xDFFF)
#: A piece: at least 16 characters up to a sentence end, a word ending in one of a few vowels and
#: digits, or a border of another script; 236 at most with its end.
PIECE = re.compile(rf"[^\n]{{16,220}}?(?:[.!?]{{1,8}}[ \t]{{1,8}}|[aeoAEO037] |[{_BORDERS}])|[^\n]{{1,236}}|\n")
SECTION = 4
LEAF = 10


def _hash(tag: bytes, *children: bytes) -> bytes:
    return hashlib.blake2b(b"".join(children), digest_size=16, person=tag).digest()


def _leaf(piece: str) -> str:
    data = piece.encode("utf-8", "surrogatepass")
    return f"{hashlib.blake2b(data, digest_size=4).hexdigest()}{len(piece):02x}"


def fingerprint(text: str) -> str:
    """Root and tree of a text. The root is over whole hashes, the tree holds short ones."""
    sections: list[tuple[bytes, str]] = []
    paragraphs: list[tuple[bytes, str]] = []
    pieces: list[str] = []
    known: dict[str, str] = {}

    def end_section() -> None:
        if paragraphs:
            sections.append((_hash(b"section", *(h for h, _ in paragraphs)), ";".join(p for _, p in paragraphs)))
            paragraphs.clear()

    def end_paragraph() -> None:
        if not pieces:
            return
        for p in pieces:
            if p not in known:
                known[p] = _leaf(p)
        whole = _hash(b"paragraph", "".join(pieces).encode("utf-8", "surrogatepass"))
        paragraphs.append((whole, "".join([known[p] for p in pieces])))
        if pieces == ["\n"] or whole[0] % SECTION == 0:
            end_section()
        pieces.clear()

    for piece in PIECE.findall(text):
        pieces.append(piece)
        if piece == "\n":
            end_paragraph()
    end_paragraph()
    end_section()
    root = _hash(b"root", *(h for h, _ in sections))
    return "/".join([root.hex(), *(s for _, s in sections)])


def _lengths(nodes: Sequence[str]) -> list[int]:
    """Where each node starts, in code points, and the end."""
    ends = [0]
    for node in nodes:
        flat = node.replace("/", "").replace(";", "")
        ends.append(ends[-1] + sum(int(flat[i + 8:i + LEAF], 16) for i in range(0, len(flat), LEAF)))
    return ends


def _length(branch: str) -> int:
    return _lengths([branch])[-1]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rise in both places; they rise in the first already."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, (_, k) in enumerate(pairs):
        at = bisect_right(tails, k)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(k)
            ends.append(i)
        else:
            tails[at], ends[at] = k, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _gaps(left: Sequence[str], right: Sequence[str]) -> list[tuple[int, int, int, int]]:
    """Ranges of two lists of nodes that are not paired: common ends are paired, then nodes that
    occur once in both, in the order they keep, and so on between these."""
    found, open_ = [], [(0, len(left), 0, len(right))]
    while open_:
        i, j, k, m = open_.pop()
        while i < j and k < m and left[i] == right[k]:
            i, k = i + 1, k + 1
        while i < j and k < m and left[j - 1] == right[m - 1]:
            j, m = j - 1, m - 1
        if i == j and k == m:
            continue
        once: dict[str, int] = {}
        for at in range(k, m):
            once[right[at]] = -1 if right[at] in once else at
        own: dict[str, int] = {}
        for at in range(i, j):
            own[left[at]] = -1 if left[at] in own else at
        anchors = _rising([(at, once[x]) for x, at in own.items() if at >= 0 and once.get(x, -1) >= 0])
        if not anchors:
            found.append((i, j, k, m))
            continue
        for (at, to), (end, stop) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True):
            open_.append((at + 1, end, to + 1, stop))
    return sorted(found)


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where two texts differ, from their fingerprints: start and stop in the one, start and
    stop in the other, in code points, as fine as pieces."""
    if a[:32] == b[:32]:
        return []

    def split(tree: str, level: int) -> list[str]:
        if not tree:
            return []
        return tree.split("/;"[level]) if level < 2 else [tree[i:i + LEAF] for i in range(0, len(tree), LEAF)]

    def descend(one: str, two: str, at: int, to: int, level: int) -> list[tuple[int, int, int, int]]:
        left, right = split(one, level), split(two, level)
        starts, others = _lengths(left), _lengths(right)
        found = []
        for i, j, k, m in _gaps(left, right):
            if level < 2 and j > i and m > k:
                # Borders may have moved as well: compare the branches one level down, all together.
                lower = ";" if level == 0 else ""
                found += descend(lower.join(left[i:j]), lower.join(right[k:m]), at + starts[i], to + others[k], level + 1)
            else:
                found.append((at + starts[i], at + starts[j], to + others[k], to + others[m]))
        return found

    return descend(a[33:], b[33:], 0, 0, 0)


def _shared(a: str, b: str, parted: list[tuple[int, int, int, int]]) -> float:
    whole = _length(a[33:]) + _length(b[33:])
    return 1.0 if not whole else 1 - sum(j - i + m - k for i, j, k, m in parted) / whole


def likeness(a: str, b: str) -> float:
    """The share of both texts outside the stretches where they differ; 1 for equal roots."""
    return 1.0 if a[:32] == b[:32] else _shared(a, b, edits(a, b))


def edited(text: str, other: str) -> str:
    """The last half (rounded down) replaced by the first as many code points of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


FIELDS = [
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("edits", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "stop", "new_start", "new_stop")]))),
]
SCHEMA = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double, edits array<struct<start: long, stop: long, new_start: long, new_stop: long>>")


def _row(id_: int | None, text: str, own: str, following: str, its: str) -> tuple:
    changed = edited(text, following)
    print_ = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    parted = edits(own, print_)
    places = [dict(zip(("start", "stop", "new_start", "new_stop"), x, strict=True)) for x in parted]
    return id_, len(text), digest, own, print_, _shared(own, print_, parted), likeness(own, its), places


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], [n for n, _ in FIELDS])


def _place(id_: int | None, tie: int) -> tuple[bool, int, int]:
    """Sort key: descending id, null ids last, then the hash of the text."""
    return id_ is None, 0 if id_ is None else ~id_, tie


def in_order_with_next_head(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text``, ``part`` and ``ghost``: the rows dealt to parts by their order, sorted
    within each, and the first row of every part once more, as a ghost at the end of the part
    before. The last part ends in the first part's ghost.

    Ids and text hashes alone are sorted first; one bound per part, whose number is that of the
    shuffle partitions, comes to the driver. The texts are shuffled once."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("id").desc_nulls_last(), F.col("tie").asc()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    placed = settle(rows.select("id", "tie").repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "order")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("place"), "tie", "id"))
    heads = placed.groupBy("part").agg(first.alias("x")).select("x.id", "x.tie").collect()
    bounds = sorted(_place(r["id"], r["tie"]) for r in heads)

    def route(ids: pa.Array, ties: pa.Array) -> pa.Array:
        out = []
        for id_, tie in zip(ids.to_pylist(), ties.to_pylist(), strict=True):
            place = _place(id_, tie)
            part = bisect_right(bounds, place) - 1
            out.append([part, (part - 1) % len(bounds)] if place == bounds[part] else [part])
        return pa.array(out, pa.list_(pa.int32()))

    routed = rows.withColumn("parts", F.arrow_udf(route, "array<int>")("id", "tie"))
    dealt = routed.select("id", "text", "tie", F.posexplode("parts").alias("ghost", "part"))
    return dealt.repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("ghost", *keys).select("id", "text", "ghost")


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprint, that of the text edited by its next document's start, how like the
    edited and the next document are, and where the edited text differs. A task walks one part in
    order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, size = None, [], 0
        for batch in batches:
            for id_, text, ghost in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("ghost").to_pylist(), strict=True):
                text = text.as_py()
                own = fingerprint(text)
                if last is not None:
                    out.append(_row(*last, text, own))
                # Equal rows at the head of a part give equal ghosts; the first one counts.
                last, size = None if ghost else (id_, text, own), size + len(text)
                if out and size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    walked = in_order_with_next_head(docs, id_col, text_col).mapInArrow(walk, SCHEMA)
    return walked.withColumnRenamed("id", id_col)
