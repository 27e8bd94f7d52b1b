"""Ranked lexical search: the best documents of every query, by best-first search over intervals.

Documents are dealt to segments, sorted by id. In a segment every term of a query has a posting
list (documents and the term's impact on their scores) with a sparse table of range maxima over
it. An interval of documents is bounded by the sum of its terms' greatest impacts, each one answer
of a range-maximum query. The search takes the intervals of the highest bounds, scores the
document of the greatest impact in each, and puts back the intervals on both sides of it, until
no bound reaches the scores already found. Bounds are exact upper bounds, so no document is lost.
Many intervals are taken at a time, so that one step is a few array operations.

Score: terms are maximal runs of ASCII letters and digits and of all other code points beyond
ASCII, only A to Z lower-cased. With N documents that hold a term, L terms in all, n in the
document, df documents with the term and tf occurrences, w = floor(1000 ln((2N + 2) / (2 df + 1))),
m = 50 + (50 n N) div L, and a term of the query adds w * ((1000000000 tf) div (1000 tf + 20 m)).

A null or empty text has no terms: such a document is never found, such a query finds nothing. A
repeated row is a document, or a query, of its own. Equal scores go by id, null ids last. Very long
texts are counted whole, in slices. Without documents or queries the result is empty. Other
columns are ignored, whatever their names.

At scale: distinct texts of queries are taken in blocks of ``BLOCK`` bytes, one after the other,
as a block's terms are held by the driver and every task; documents are read once per block and
leave numbers of the block's terms only. Segments are dealt evenly, whatever a document or a term
weighs, and end at ``POSTINGS`` postings, which bounds a task's tables. A task carries the scores
it has found from segment to segment and returns the best of each query, which a window limits
again before and after its shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlytics.storage import new_folder, settle

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of query texts in a block, in the mean.
BLOCK = 1 << 20
#: Postings in a segment; a document's own postings are never parted.
POSTINGS = 1 << 20
#: Documents in a task, about; with fewer documents than cores fill, a core's share of them.
TASK_DOCS = 1 << 15
LEAST_TASK_DOCS = 1 << 12
#: Intervals taken at a time.
WAVE = 64
_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: A null id, behind all others.
NO_ID = np.iinfo(np.int64).max


def lowered(term: str) -> str:
    return term.lower() if term.isascii() else term.translate(_LOWER)


def terms_of(text: str | None) -> Counter:
    """Occurrences of each term, in any case. A long text is counted in slices."""
    if not text:
        return Counter()
    if len(text) < 1 << 22:
        return Counter(TERM.findall(text))
    found: Counter = Counter()
    found.update(m.group() for m in TERM.finditer(text))
    return found


def tallied(docs: DataFrame, numbers: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """Per document that holds a term: id, number of its terms, and the numbers and occurrences
    of those that ``numbers`` names."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, sizes, terms, times = [], [], [], []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                own: dict[int, int] = {}
                for term, n in found.items():
                    number = known.get(lowered(term))
                    if number is not None:
                        own[number] = own.get(number, 0) + n
                ids.append(id_)
                sizes.append(found.total())
                terms.append(list(own))
                times.append(list(own.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                ["id", "n", "terms", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return settle(rows.mapInArrow(tally, "id long, n long, terms array<int>, times array<long>"), "postings")


class Segment:
    """Posting lists of some documents, one after the other by term and within by document,
    with sparse tables of the places of range maxima."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        term = term[order]
        self.key = (term.astype(np.int64) << 32) | self.doc
        self.terms, starts = np.unique(term, return_index=True)
        self.starts, self.ends = starts, np.append(starts[1:], len(term))
        # best[j][i]: the place of the first greatest impact among the 2**j postings from i on.
        self.best = [np.arange(len(term))]
        longest = int((self.ends - self.starts).max(initial=0))
        while 2 << (len(self.best) - 1) <= longest:
            below, half = self.best[-1], 1 << (len(self.best) - 1)
            left, right = below[:-half], below[half:]
            self.best.append(np.where(self.impact[right] > self.impact[left], right, left))
        width = len(term)
        self.table = np.zeros((len(self.best), width), np.int32)
        for j, row in enumerate(self.best):
            self.table[j, :len(row)] = row
        del self.best

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the terms have postings here, and where these begin and end."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        return here, self.starts[at[here]], self.ends[at[here]]

    def maxima(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and size of the greatest impact in each range of postings; 0 in an empty one."""
        length = right - left
        some = length > 0
        level = np.frexp(np.maximum(length, 1))[1] - 1
        low = np.where(some, left, 0)
        one = self.table[level, low]
        two = self.table[level, np.where(some, right - (1 << level), 0)]
        place = np.where(self.impact[two] > self.impact[one], two, one)
        return place, np.where(some, self.impact[place], 0)


class Best:
    """The ``top`` best (score, id) so far, the lesser id first among equal scores."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]

    def beaten_by(self, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of these could still get in."""
        if len(self.scores) < self.top:
            return bounds > 0
        worst = self.scores[-1]
        return (bounds > worst) | ((bounds == worst) & (ids < self.ids[-1]))


def search(segment: Segment, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Add the segment's best documents for one query."""
    here, left, right = segment.lists(terms)
    if not here.any():
        return
    terms, weights = terms[here].astype(np.int64), weights[here]

    def bounded(left: np.ndarray, right: np.ndarray) -> tuple:
        place, most = segment.maxima(left, right)
        worth = weights * most
        first = np.where(right > left, segment.doc[np.minimum(left, len(segment.doc) - 1)], len(segment.ids)).min(axis=1)
        split = segment.doc[np.take_along_axis(place, worth.argmax(axis=1)[:, None], 1)[:, 0]]
        return left, right, worth.sum(axis=1), first, split

    open_ = bounded(left[None, :], right[None, :])
    while True:
        alive = best.beaten_by(open_[2], segment.ids[np.minimum(open_[3], len(segment.ids) - 1)])
        open_ = tuple(x[alive] for x in open_)
        if not len(open_[2]):
            return
        order = np.lexsort((open_[3], -open_[2]))
        wave, rest = order[:WAVE], order[WAVE:]
        left, right, _, _, split = (x[wave] for x in open_)
        middle = np.searchsorted(segment.key, (terms << 32)[None, :] | split[:, None].astype(np.int64))
        middle = np.clip(middle, left, right)
        at = np.minimum(middle, len(segment.doc) - 1)
        holds = (middle < right) & (segment.doc[at] == split[:, None])
        best.add((weights * np.where(holds, segment.impact[at], 0)).sum(axis=1), segment.ids[split])
        halves = bounded(np.concatenate([left, middle + holds]), np.concatenate([middle, right]))
        open_ = tuple(np.concatenate([x[rest], y]) for x, y in zip(open_, halves, strict=True))


def _segments(batches: Iterator[pa.RecordBatch], docs: int, terms: int) -> Iterator[Segment]:
    """Segments of the rows as they come; ``docs`` and ``terms`` are N and L."""
    parts: list[tuple] = []
    held = 0

    def built() -> Segment:
        ids, sizes, counts, term, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        m = 50 + np.array([50 * n * docs // terms for n in sizes.tolist()], np.int64)
        impact = (1_000_000_000 * times) // (1000 * times + 20 * np.repeat(m, counts))
        return Segment(ids[order], np.repeat(rank, counts), term, impact)

    for batch in batches:
        lists = batch.column("terms")
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        kept = batch.filter(pa.array(counts > 0))
        counts = counts[counts > 0]
        ends = np.cumsum(counts)
        start = 0
        while start < len(counts):
            room = POSTINGS - held + (ends[start - 1] if start else 0)
            stop = max(int(np.searchsorted(ends, room, side="right")), start + (not held))
            if stop > start:
                piece = kept.slice(start, stop - start)
                ids = piece.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                parts.append((ids, piece.column("n").to_numpy(), counts[start:stop], piece.column("terms").flatten().to_numpy(), piece.column("times").flatten().to_numpy()))
                held += int(counts[start:stop].sum())
            if stop < len(counts):
                yield built()
                parts, held = [], 0
            start = stop
    if parts:
        yield built()


def _block(texts: list[tuple[int, str]], docs: DataFrame, top: int, id_col: str, text_col: str) -> DataFrame | None:
    """``query``, ``id`` and ``score``: each task's best documents of every query of a block."""
    spark = docs.sparkSession
    numbers: dict[str, int] = {}
    queries = []
    for key, text in texts:
        own = {lowered(t) for t in terms_of(text)}
        queries.append((key, sorted(numbers.setdefault(t, len(numbers)) for t in own)))
    postings = tallied(docs, numbers, id_col, text_col)
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    # One row per term of the block.
    found = postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()
    weight = np.zeros(len(numbers), np.int64)
    for r in found:
        weight[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    asked = [(key, np.array([t for t in terms if weight[t] > 0], np.int64)) for key, terms in queries]
    shared = spark.sparkContext.broadcast((weight, asked))

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked = shared.value
        best = [Best(top) for _ in asked]
        for segment in _segments(batches, n_docs, n_terms):
            for (_, terms), own in zip(asked, best, strict=True):
                search(segment, terms, weight[terms], own)
        for (key, _), own in zip(asked, best, strict=True):
            if len(own.scores):
                ids = pa.array(own.ids, pa.int64(), mask=own.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key), pa.int64()), ids, pa.array(own.scores)], ["query", "id", "score"])

    cores = spark.sparkContext.defaultParallelism
    tasks = max(-(-n_docs // TASK_DOCS), min(cores, -(-n_docs // LEAST_TASK_DOCS)))
    return postings.select("id", "n", "terms", "times").repartition(tasks).mapInArrow(best_of, "query long, id long, score long")


def search_all(
    docs: DataFrame, queries: DataFrame, top: int, *, id_col: str = "doc_id", text_col: str = "text",
    query_id_col: str = "item_id", query_text_col: str = "text",
) -> DataFrame:
    """The ``top`` documents of the highest scores above 0 of every query, ranked from 1."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id_col).alias("item"), F.col(query_text_col).alias("text"), F.xxhash64(F.col(query_text_col)).alias("query"))
    # Equal texts are searched once; a text goes by its 64-bit hash from here on.
    texts = settle(asked.where(F.length("text") > 0).groupBy("query").agg(F.min("text").alias("text")), "queries")
    volume = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-volume // BLOCK)
    found = []
    for i in range(blocks):
        mine = texts.where(F.pmod("query", F.lit(blocks)) == i).select("query", "text").collect()
        results = _block([(r["query"], r["text"]) for r in mine], docs, top, id_col, text_col) if mine else None
        if results is not None:
            path = new_folder(spark, "found")
            results.write.parquet(path)
            found.append(path)
    schema = "query long, id long, score long"
    every = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    ordered = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    return asked.select("item", "query").join(ranked, "query").select(
        F.col("item").alias(query_id_col), "rank", F.col("id").alias(id_col), "score")
