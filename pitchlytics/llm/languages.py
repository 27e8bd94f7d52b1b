"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point, so all tasks draw the
same one. A letter n-gram is bound into one vector: the product of its letters' vectors, each
permuted (rotated) as often as letters follow it. The sum of a text's n-gram vectors is its
profile; the sum over all training texts of a language is the language's prototype. A document
gets the language of the prototype with the largest cosine, the first by name if tied.

Anything but a letter counts as a space, and runs of spaces as one. A null text, or one without
a letter, is ``und`` with score 0, as is every text when there is nothing to learn from. Texts
are profiled whole, of any length, in any mix of scripts, in bounded memory beside the text. Rows with a null label are not learned from. An empty table gives an empty
result. Other columns are ignored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlytics.llm.helpers import mixed64
from pitchlytics.storage import settle

DIMENSIONS = 1024
GRAM = 3
#: Deviation of the cosine of two unrelated vectors.
NOISE = DIMENSIONS ** -0.5
SPACE = 32
UNKNOWN = "und"
#: Characters whose profiles are made in one matrix product.
CHUNK_CHARS = 1 << 18
#: N-grams, or pairs of text and n-gram, whose vectors are held at once.
BLOCK = 4096
#: An n-gram is common if at least one text in so many holds it.
COMMON = 128
#: Codes up to which distinct ones are found through a table and not by sorting.
TABLE = 1 << 22
#: Languages that may be learned; more are refused, as all prototypes go to every task.
MAX_LANGUAGES = 1000

_LETTERS: dict[int, np.ndarray] = {}
_LOWER: list[np.ndarray] = []


def letter_vector(code: int) -> np.ndarray:
    """The vector of one letter, from its code point."""
    if code not in _LETTERS:
        words = mixed64(np.arange(DIMENSIONS // 64, dtype=np.uint64), seed=code)
        bits = np.unpackbits(words.view(np.uint8), bitorder="little")
        _LETTERS[code] = (2 * bits.astype(np.int8) - 1).astype(np.int8)
    return _LETTERS[code]


def _lower() -> np.ndarray:
    """Lower-case letter of each code point of the basic plane, a space for all others."""
    if not _LOWER:
        codes = np.full(0x10000, SPACE, np.uint32)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                codes[i] = ord(c.lower()[0])
        _LOWER.append(codes)
    return _LOWER[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts, a space before and after each, and the text of each code."""
    raw = [np.frombuffer((" " + t + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(r) for r in raw])
    codes = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
    wide = codes >= 0x10000
    lower = _lower()[np.where(wide, SPACE, codes)]
    for c in np.unique(codes[wide]):
        x = chr(int(c))
        if x.isalpha():
            lower[codes == c] = ord(x.lower()[0])
    space = lower == SPACE
    keep = ~space
    keep[1:] |= space[1:] & ~(space[:-1] & (owner[1:] == owner[:-1]))
    keep[:1] = True
    return lower[keep], owner[keep]


def ranked(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the rank of each code among them."""
    if size > TABLE:
        return np.unique(codes, return_inverse=True)
    present = np.zeros(size, bool)
    present[codes] = True
    return np.flatnonzero(present), (np.cumsum(present) - 1)[codes]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of the distinct n-grams (a row each); of every n-gram its text and its row."""
    codes, owner = letters(texts)
    alphabet, at = ranked(codes, int(codes.max(initial=0)) + 1)
    n = max(0, len(at) - GRAM + 1)
    whole = owner[:n] == owner[GRAM - 1:GRAM - 1 + n]
    members = np.arange(len(alphabet))[:, None]
    rank = at.astype(np.int64)
    for k in range(1, GRAM):
        size = len(members) * len(alphabet)
        distinct, rank = ranked(rank[:len(rank) - 1] * len(alphabet) + at[k:], size)
        members = np.concatenate([members[distinct // len(alphabet)], (distinct % len(alphabet))[:, None]], axis=1)
    return alphabet[members] if len(alphabet) else np.zeros((0, GRAM), np.uint32), owner[:n][whole], rank[whole]


def bound(members: np.ndarray) -> np.ndarray:
    """The vectors of n-grams given by their letter codes."""
    distinct, at = np.unique(members, return_inverse=True)
    table = np.stack([letter_vector(int(c)) for c in distinct]) if len(distinct) else np.zeros((0, DIMENSIONS), np.int8)
    at = at.reshape(members.shape)
    out = table[at[:, GRAM - 1]].copy()
    for k in range(GRAM - 1):
        out *= np.roll(table, GRAM - 1 - k, axis=1)[at[:, k]]
    return out.astype(np.float32)


def bundled(members: np.ndarray, group: np.ndarray, rank: np.ndarray, groups: int) -> np.ndarray:
    """The sum of n-gram vectors in each group, where an n-gram is given by its row in ``members``.

    A table of counts of up to ``TABLE`` cells is multiplied as it is. In a larger one n-grams that
    many groups hold are multiplied as a matrix, in blocks of bounded size, and all others are
    added one pair of group and n-gram after the other, so memory follows the number of n-grams
    and never groups times n-grams. The sums are the same."""
    out = np.zeros((groups, DIMENSIONS))
    width = max(1, len(members))
    key = group.astype(np.int64) * width + rank
    if groups * width <= TABLE:
        counts = np.bincount(key, minlength=groups * width).reshape(groups, width)
        for start in range(0, len(members), BLOCK):
            out += counts[:, start:start + BLOCK].astype(np.float32) @ bound(members[start:start + BLOCK])
        return out
    pair, count = np.unique(key, return_counts=True)
    group, rank = pair // width, pair % width
    common = np.bincount(rank, minlength=width) * COMMON >= groups
    column = np.cumsum(common) - 1
    dense, wide = common[rank], np.flatnonzero(common)
    by_column = np.argsort(column[rank[dense]], kind="stable")
    at, row, n = column[rank[dense]][by_column], group[dense][by_column], count[dense][by_column]
    step = max(1, min(BLOCK, BLOCK * DIMENSIONS // max(1, groups)))
    for start in range(0, len(wide), step):
        some = wide[start:start + step]
        a, b = np.searchsorted(at, [start, start + len(some)])
        table = np.zeros((groups, len(some)), np.float32)
        table[row[a:b], at[a:b] - start] = n[a:b]
        out += table @ bound(members[some])
    row, rank, n = group[~dense], rank[~dense], count[~dense]
    for start in range(0, len(row), BLOCK):
        here = row[start:start + BLOCK]
        first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        vectors = bound(members[rank[start:start + BLOCK]]) * n[start:start + BLOCK, None].astype(np.float32)
        out[here[first]] += np.add.reduceat(vectors, first, axis=0)
    return out


def profiles(texts: list[str]) -> np.ndarray:
    """The sum of each text's n-gram vectors, a row per text."""
    return bundled(*grams(texts), len(texts))


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts of about ``CHUNK_CHARS`` characters."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 2
        if held >= CHUNK_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def has_letter(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=codes != SPACE, minlength=n) > 0


def learn(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Prototypes from all rows with a label. Each task adds up its own sums per language, the
    rest is a grouped sum; one vector per language comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in chunks(texts):
                members, owner, rank = grams(texts[a:b])
                names, of = np.unique(np.array(langs[a:b], object), return_inverse=True)
                for name, row in zip(names, bundled(members, of[owner], rank, len(names)), strict=True):
                    sums[name] = sums.get(name, 0) + np.rint(row).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    added = rows.mapInArrow(run, "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("at", "x"))
    table = settle(added.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).getField("x").alias("sums")), "prototypes")
    found = table.limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return {r["lang"]: np.array(r["sums"], float) for r in sorted(found, key=lambda r: r["lang"]) if any(r["sums"])}


def noise_bound(languages: int) -> float:
    """Score that a text unrelated to all prototypes hardly reaches: four deviations, and what
    the largest of so many normal scores adds."""
    return NOISE * (4 + math.sqrt(2 * math.log(max(1, languages))))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with the prototype, at least 0.
    Only the texts decide; input columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    names = list(prototypes)
    table = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names], np.float32).reshape(-1, DIMENSIONS)

    def judge(texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for a, b in chunks(texts):
            some = texts[a:b]
            known = has_letter(*letters(some), len(some))
            vectors = profiles(some)
            size = np.linalg.norm(vectors, axis=1)
            cosine = (vectors @ table.T) / np.maximum(size, 1e-9)[:, None] if names else np.zeros((len(some), 0))
            best = cosine.argmax(axis=1) if names else np.zeros(len(some), int)
            for i in range(len(some)):
                sure = known[i] and bool(names)
                langs.append(names[best[i]] if sure else UNKNOWN)
                scores.append(float(min(1.0, max(0.0, cosine[i, best[i]]))) if sure else 0.0)
        return langs, scores

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            langs, scores = judge([t if t is not None else "" for t in texts])
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    judged = F.pandas_udf(run, "lang_pred string, score double")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], judged(F.col(text_col)).alias("_judged"))
    return rows.select(*[F.col(f"`{c}`") for c in kept], "_judged.lang_pred", "_judged.score")
