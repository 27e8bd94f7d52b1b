"""Secret scan: fixed patterns, and a randomness test battery on other strings.

Fixed patterns (``assign``, ``access``, ``hex``) are leftmost, non-overlapping matches of their
kind. Beside them every maximal run of characters of encoded data is a candidate. The narrowest
encoding that holds it is inferred (hexadecimal, base32, base64), its symbols become numbers,
and three tests ask whether they are uniform noise: chi-squared of the symbol counts, runs
above and below the middle of the alphabet, and serial correlation of neighbours. A candidate
that any of them rejects is no secret.

Passing proves little for a short string, so the likelihood of noise is also divided by that of
text. Text is a bigram model whose counts come from the corpus itself, from all words but those
that could be secrets; at any letter a new word may begin (``JOIN``), and upper-case words are
also read in lower case. Under text the ratio exceeds x with probability 1/x at most (Markov),
so its inverse is a p-value. The marks / + - _ weigh nothing: words beside them stand alone.
Where some words of a run are text and others noise, the run is split at the marks, and the
p-value pays for the choice. The p-values of all candidates of the corpus, in classes of equal
encoding and length, go through Benjamini and Hochberg's step-up, so that the expected share of
false findings is at most ``rate`` in each class, however many candidates there are.

Null texts are empty. Texts are read whole. Rows are kept apart, so repeated ids give repeated
rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlytics.llm.helpers import texts_of
from pitchlytics.storage import settle

# The patterns and least lengths of the base findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 characters or more
KINDS = ("assign", "access", "hex", "random_hex", "random_base32", "random_base64")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,6}")
ALPHABETS = {
    "hex": ("0123456789abcdef", "0123456789ABCDEF"),
    "base32": (string.ascii_uppercase + "234567", string.ascii_lowercase + "234567"),
    "base64": (string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
               string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
}
#: Two-sided level at which each test of the battery rejects uniform noise.
NOISE_LEVEL = 1e-4
#: Sum over symbols of q * q * K for text of K symbols, less one: how uneven ordinary letters are.
TEXT_EXCESS = {"hex": 0.9, "base32": 1.1, "base64": 2.4}
#: Words of a run, and runs that may be secrets and are not learned from.
WORD = re.compile(r"[A-Za-z0-9]+")
UNLEARNED = re.compile(r"[A-Za-z0-9+/_-]{16,}")
SYMBOLS = string.ascii_letters + string.digits
#: Chance that text joins a new word to the last one without a mark, as in camelCase.
JOIN = 0.1
#: Chances that a word begins with a capital, that it is a number, and that a number goes on.
CAPITAL, NUMBER, MORE_DIGITS = 0.1, 0.3, 0.8
#: Weight of a letter's overall frequency beside the counts after one letter.
BACKOFF = 10.0
#: Alphabets that are tried, and the gain in log likelihood from which a run is split.
TRIED, SPLIT_GAIN = 6, 5.0
#: Lengths from each bound on form one class.
LENGTH_BOUNDS = (20, 24, 32, 48, 64, 128, 256)
#: Steps of -log10 p; p-values are rounded up to a step, never down.
STEP, MOST_STEPS = 0.05, 400

SPAN = "array<struct<kind:string,start:long,stop:long,step:int,group:int>>"


def _upper(z: float) -> float:
    """Upper tail of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_upper(x: float, k: float) -> float:
    """Upper tail of chi-squared by Wilson and Hilferty's cube root."""
    return _upper(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def encoding_of(text: str) -> tuple[str, str] | None:
    """The narrowest encoding whose alphabet holds the text, and that alphabet; None for
    words: runs without a digit, of digits only, or with no letters."""
    core = text.rstrip("=")
    used = set(core)
    if not used & set(string.digits) or not used & set(string.ascii_letters):
        return None
    for name, alphabets in ALPHABETS.items():
        for alphabet in alphabets:
            if used <= set(alphabet):
                return name, alphabet
    return None


def battery(text: str) -> tuple[str, dict[str, float], float] | None:
    """Encoding, p-values of the tests under uniform noise, and the p-value under text."""
    found = encoding_of(text)
    if found is None:
        return None
    name, alphabet = found
    symbols = np.array([alphabet.index(c) for c in text.rstrip("=")], float)
    n, k = len(symbols), len(alphabet)
    counts = np.bincount(symbols.astype(int), minlength=k)
    chi2 = float(((counts - n / k) ** 2).sum() * k / n)
    # Few symbols for many cells: variance of the statistic for multinomial counts.
    spread = math.sqrt(2 * (k - 1) * (n - 1) / n)
    uniform = _chi2_upper(max(chi2, 1e-9), k - 1) if n >= 5 * k else _upper((chi2 - (k - 1)) / spread)
    high = symbols >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        deviation = math.sqrt(max(1e-9, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))))
        runs_p = 2 * _upper(abs(runs - mean) / deviation)
    else:
        runs_p = 2.0 ** (1 - n)
    centred = symbols - symbols.mean()
    square = float((centred ** 2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / square if square else 1.0
    serial_p = 2 * _upper(abs(serial + 1 / n) * math.sqrt(n))
    excess = (n - 1) * TEXT_EXCESS[name]
    text_p = _upper((k - 1 + excess - chi2) / math.sqrt(2 * (k - 1) + 4 * excess))
    return name, {"chi2": uniform, "runs": runs_p, "serial": serial_p}, text_p


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Findings of the fixed patterns, by kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _symbols() -> np.ndarray:
    """Number of each code of the basic plane: 1 to 62 for letters and digits, 0 for all others."""
    table = np.zeros(0x10000, np.int64)
    table[[ord(c) for c in SYMBOLS]] = np.arange(1, len(SYMBOLS) + 1)
    return table


SYMBOL = _symbols()


def bigrams(texts: list[str]) -> np.ndarray:
    """Counts of neighbours (before, letter), runs that may be secrets left out."""
    def plain(m: re.Match) -> str:
        return " " if encoding_of(m[0]) else m[0]

    text = " " + " ".join(UNLEARNED.sub(plain, t) for t in texts)
    at = SYMBOL[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
    n = len(SYMBOLS) + 1
    counts = np.bincount(at[:-1] * n + at[1:], minlength=n * n).reshape(n, n)
    counts[:, 0] = 0
    return counts


class TextModel:
    """Negative log likelihood of words as text, from counts of neighbours."""

    def __init__(self, counts: np.ndarray):
        letters = counts[:, 1:].astype(float)
        lower, upper, digits = slice(0, 26), slice(26, 52), slice(52, 62)
        overall = letters.sum(axis=0) + 0.5
        first = letters[0] + 0.5
        overall, first = overall / overall.sum(), first / first.sum()
        # A corpus of plain prose still has names in capitals and numbers.
        capital = np.zeros_like(first)
        capital[upper] = first[lower] / first[lower].sum()
        first = (1 - NUMBER) * ((1 - CAPITAL) * first + CAPITAL * capital)
        first[digits] += NUMBER / 10
        after = (letters + BACKOFF * overall) / (letters.sum(axis=1, keepdims=True) + BACKOFF)
        small, large = slice(1, 27), slice(27, 53)
        after[large] = (letters[large] + BACKOFF * after[small]) / (letters[large].sum(axis=1, keepdims=True) + BACKOFF)
        after[53:] = (1 - MORE_DIGITS) * after[53:]
        after[53:, digits] += MORE_DIGITS / 10
        after = (1 - JOIN) * after + JOIN * first
        after[0] = first
        self.cost = np.hstack([np.zeros((len(after), 1)), -np.log(after)])

    def _of(self, word: str) -> float:
        at = SYMBOL[np.frombuffer((" " + word).encode("utf-32-le"), np.uint32)]
        return float(self.cost[at[:-1], at[1:]].sum())

    def word(self, word: str) -> float:
        return min(self._of(word), self._of(word.lower())) if word.upper() == word else self._of(word)


def split(run: str, model: TextModel) -> list[tuple[int, int, float]]:
    """Parts of a run that are judged, with the log of the number of parts chosen from."""
    words = [(m.start(), m.end(), model.word(m[0]) - len(m[0]) * math.log(64)) for m in WORD.finditer(run.rstrip("="))]
    price = math.log(max(1, len(words) * (len(words) + 1) // 2))
    found = []

    def look(a: int, b: int) -> None:
        best, total, start = (-math.inf, a, a), 0.0, a
        for i in range(a, b):
            if total <= 0:
                total, start = 0.0, i
            total += words[i][2]
            best = max(best, (total, start, i + 1))
        if best[0] > 0 and best[1] < best[2]:
            pieces.append(best[1:])

    pieces: list[tuple[int, int]] = []
    todo = [(0, len(words))]
    while todo:
        a, b = todo.pop()
        had = len(pieces)
        look(a, b)
        if len(pieces) > had:
            x, y = pieces[-1]
            todo += [(x0, y0) for x0, y0 in ((a, x), (y, b)) if x0 < y0]
    gain = sum(w[2] for x, y in pieces for w in words[x:y]) - sum(w[2] for w in words)
    if gain > SPLIT_GAIN + price:
        found = [(words[x][0], len(run) if y == len(words) else words[y - 1][1], price) for x, y in sorted(pieces)
                 if words[y - 1][1] - words[x][0] >= LENGTH_BOUNDS[0]]
    return found or [(0, len(run), price)]


def candidates(text: str, known: list[tuple[str, int, int]], model: TextModel | None = None) -> list[tuple[str, int, int, int, int]]:
    """Noise-like runs that touch no known span: kind, start, stop, step of -log10 p, class of
    encoding and length."""
    model = model or TextModel(np.zeros((len(SYMBOLS) + 1,) * 2))
    found = []
    known = sorted(known, key=lambda s: s[1])
    starts, ends = [s[1] for s in known], list(accumulate((s[2] for s in known), max))
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())
        if before and ends[before - 1] > m.start():
            continue
        for start, stop, price in split(m[0], model):
            part = m[0][start:stop]
            tested = battery(part)
            if tested is None:
                continue
            name, noise, _ = tested
            words = WORD.findall(part.rstrip("="))
            ratio = sum(model.word(w) for w in words) - sum(map(len, words)) * math.log(len(ALPHABETS[name][0])) - price - math.log(TRIED)
            fits = min(noise.values()) >= NOISE_LEVEL
            step = max(0, min(MOST_STEPS, int(ratio / math.log(10) / STEP))) if fits else 0
            group = list(ALPHABETS).index(name) * (len(LENGTH_BOUNDS) + 1) + sum(len(part) >= b for b in LENGTH_BOUNDS)
            found.append((f"random_{name}", m.start() + start, m.start() + stop, step, group))
    return found


def _ordered(spans: list[tuple]) -> list[tuple]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in _ordered(spans))


def learn(docs: DataFrame, *, text_col: str = "text") -> TextModel:
    """The text model of a corpus; one count per pair of letters comes to the driver."""
    n = len(SYMBOLS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n, n), np.int64)
        for batch in batches:
            counts += bigrams(texts_of(batch, "text"))
        pairs = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(counts.ravel()[pairs], pa.int64())], ["pair", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.zeros(n * n)
    for r in rows.collect():
        counts[r["pair"]] = r["n"]
    return TextModel(counts.reshape(n, n))


def scan(docs: DataFrame, *, model: TextModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, counts and joined spans of the fixed patterns (``base``) and all
    candidates with their evidence (``tried``). One pass over the texts, without a shuffle."""
    schema = f"{id_col} long, n_assign long, n_access long, n_hex long, base string, tried {SPAN}"
    tried = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("step", pa.int32()), ("group", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [base_spans(t) for t in texts_of(batch, "text")]
            more = [candidates(t, b, model) for t, b in zip(texts_of(batch, "text"), base, strict=True)]
            counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS[:3]]
            spans = [[dict(zip(("kind", "start", "stop", "step", "group"), s, strict=True)) for s in m] for m in more]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *counts, pa.array([_joined(b) for b in base]), pa.array(spans, tried)],
                [id_col, "n_assign", "n_access", "n_hex", "base", "tried"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def accepted(tried: DataFrame, rate: float) -> DataFrame:
    """Least step of each class that Benjamini and Hochberg's rule accepts, from counts
    by class and step (at most classes times steps rows)."""
    counts = (
        tried.select(F.explode("tried").alias("s")).groupBy("s.group", "s.step").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("all", F.sum("n").over(Window.partitionBy("group")))
        .withColumn("rank", F.sum("n").over(Window.partitionBy("group").orderBy(F.desc("step"))))
    )
    p = F.pow(F.lit(10.0), -F.col("step") * STEP)
    return counts.where((F.col("step") > 0) & (p <= F.lit(rate) * F.col("rank") / F.col("all"))).groupBy("group").agg(F.min("step").alias("step"))


def find_secrets(docs: DataFrame, *, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans``: joined
    ``kind:start:stop`` of the fixed patterns, and of these with the accepted candidates.
    Positions are code points, ends exclusive."""
    found = settle(scan(docs, model=learn(docs, text_col=text_col), id_col=id_col, text_col=text_col), "secrets")
    least = {r["group"]: r["step"] for r in accepted(found, rate).collect()}  # one row per class
    never = F.lit(MOST_STEPS + 1)
    steps = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else None

    def good(s):
        bound = never if steps is None else F.coalesce(F.element_at(steps, s["group"]), never)
        return s["step"] >= bound

    kept = F.filter("tried", good)
    more = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.concat_ws(":", s["kind"], s["start"], s["stop"]).alias("span")))
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("start"), x.alias("span")))
    kind = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    every = F.transform(F.concat(base, more), lambda x: F.struct(x["start"].alias("start"), F.element_at(kind, F.split(x["span"], ":")[0]).alias("kind"), x["span"].alias("span")))
    spans = F.concat_ws(",", F.transform(F.array_sort(every), lambda x: x["span"]))
    return found.select(id_col, "n_assign", "n_access", "n_hex", "base", spans.alias("spans"), F.size(kept).cast("long").alias("n_random"))


def digest(joined: str) -> str:
    """Lower-case hex SHA-256 of joined spans."""
    return hashlib.sha256(joined.encode()).hexdigest()
