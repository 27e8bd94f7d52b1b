import hashlib
import random

import pytest

from pitchlytics.llm import merkle as M


def random_text(rng, lines=12):
    words = ["alpha", "beta.", "gamma", "Delta!", "ε", "one", "two?", "x" * 40, "café"]
    return "".join(" ".join(rng.choices(words, k=rng.randint(0, 25))) + rng.choice(["\n", "\n", "\n\n"]) for _ in range(lines))


def test_pieces_cover_the_text():
    rng = random.Random(1)
    for _ in range(300):
        text = random_text(rng) + rng.choice(["", "tail", "y" * 700, "\r\n", " "])
        assert "".join(M.PIECE.findall(text)) == text
        assert M._length(M.fingerprint(text)[33:]) == len(text)


def test_roots_test_equality():
    rng = random.Random(2)
    texts = {random_text(rng) for _ in range(200)} | {"", "\n", "\n\n", " "}
    assert len({M.fingerprint(t)[:32] for t in texts}) == len(texts)
    assert all(M.fingerprint(t) == M.fingerprint(str(t)) for t in texts)


@pytest.mark.parametrize("seed", range(40))
def test_edits_cover_every_difference(seed):
    """Outside the located ranges both texts are the same."""
    rng = random.Random(seed)
    a = random_text(rng, 30)
    b = a
    for _ in range(rng.randint(1, 3)):
        at = rng.randrange(len(b))
        b = b[:at] + rng.choice(["", "NEW", "two words\n", "\n\n"]) + b[at + rng.randint(0, 30):]
    found = M.edits(M.fingerprint(a), M.fingerprint(b))
    at = to = 0
    for i, j, k, m in found:
        assert a[at:i] == b[to:k]
        at, to = j, m
    assert a[at:] == b[to:]
    assert (found == []) == (a == b)


def odd_text(rng, kind):
    """Texts of long runs of marks and blanks, or of a script without blanks."""
    if kind == "han":
        return "".join(chr(rng.randrange(0x4E00, 0x9FFF)) if rng.random() < 0.98 else rng.choice("。\n") for _ in range(400))
    parts = ["word " * 9, "." * rng.randrange(1, 700), ". " + " " * rng.randrange(700), "!?" * rng.randrange(300) + "\t" * 9, "a " * 200, "\n"]
    return "".join(rng.choice(parts) for _ in range(25))


@pytest.mark.parametrize("kind", ["han", "runs"])
def test_odd_texts_are_cut_bounded_and_edits_cover_every_difference(kind):
    for seed in range(60):
        rng = random.Random(seed)
        a = odd_text(rng, kind)
        assert "".join(M.PIECE.findall(a)) == a and max(map(len, M.PIECE.findall(a))) <= 255
        assert M._length(M.fingerprint(a)[33:]) == len(a)
        at = rng.randrange(len(a))
        b = a[:at] + odd_text(rng, kind)[:rng.randrange(300)] + a[at + rng.randrange(300):]
        i = k = 0
        for start, stop, to, end in M.edits(M.fingerprint(a), M.fingerprint(b)):
            assert a[i:start] == b[k:to]
            i, k = stop, end
        assert a[i:] == b[k:]


def test_leaders_and_blanks_do_not_part_the_rest():
    lines = [f"chapter {i} begins here and goes on for a while\n" for i in range(30)]
    for run in (". " + " " * 300, "." * 300):
        a, b = ["".join([*lines, "title " + x + "12\n", *lines[::-1]]) for x in (run, run[:-60])]
        assert M.likeness(M.fingerprint(a), M.fingerprint(b)) > 0.8


def test_half_of_a_han_text():
    found = []
    for seed in range(40):
        rng = random.Random(seed)
        one, two = ("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(200)) for _ in range(2))
        found.append(M.likeness(M.fingerprint(one), M.fingerprint(one[:100] + two[:100])))
    assert sum(found) / len(found) > 0.35 and min(found) > 0


def test_order_counts():
    rng = random.Random(8)
    lines = [f"line {i} {rng.random()} of a text in which no line is like another\n" for i in range(60)]
    a, b = "".join(lines), "".join(lines[30:] + lines[:30])
    assert 0.4 < M.likeness(M.fingerprint(a), M.fingerprint(b)) < 0.6


def test_many_pieces_are_compared_in_time():
    import time

    rng = random.Random(9)
    words = [str(rng.random()) for _ in range(40_000)]
    a, b = " ".join(words), " ".join(words[:20_000] + ["new"] + words[20_000:])
    same = ("la la la. " * 30 + "\n") * 2_000
    start = time.perf_counter()
    assert M.likeness(M.fingerprint(a), M.fingerprint(b)) > 0.99
    assert M.likeness(M.fingerprint(same), M.fingerprint(same[10:])) > 0.9
    assert time.perf_counter() - start < 20


def test_one_edit_is_located_closely():
    rng = random.Random(5)
    a = random_text(rng, 200)
    at = a.index("alpha", len(a) // 2)
    b = a[:at] + "ALPHA" + a[at + 5:]
    (i, j, k, m), = M.edits(M.fingerprint(a), M.fingerprint(b))
    assert i <= at < at + 5 <= j and j - i < 300 and m - k < 300


def test_likeness():
    rng = random.Random(6)
    a, b = random_text(rng, 80), random_text(rng, 80)
    half = M.likeness(M.fingerprint(a), M.fingerprint(a[:len(a) // 2] + b[:len(a) // 2]))
    assert M.likeness(M.fingerprint(a), M.fingerprint(a)) == 1 and 0.35 < half < 0.85
    assert M.likeness(M.fingerprint(""), M.fingerprint("")) == 1 and M.likeness(M.fingerprint(""), M.fingerprint("x")) == 0


def expected(texts):
    order = sorted(range(len(texts)), reverse=True)
    for n, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        one, two = M.fingerprint(text), M.fingerprint(changed)
        yield (i, len(text), hashlib.sha256(changed.encode()).hexdigest(), one, two, M.likeness(one, two), M.likeness(one, M.fingerprint(following)))


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_next_document_across_parts(spark, docs, rows, parts):
    rng = random.Random(7)
    texts = [random_text(rng, 4) for _ in range(40)] + [None, "", "é😀", "z" * 5000, "same\nlines\n", "same\nlines\n"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows(M.compare_with_next(docs(texts, extra=("part", "kind", "tie")).repartition(3)), *COLUMNS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(expected(texts))


def test_one_row_null_ids_and_none(spark, docs):
    alone = M.compare_with_next(docs(["abcd"])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1
    table = spark.createDataFrame([(None, "n"), (1, "a"), (1, "a"), (2, "b"), (None, None)], "doc_id long, text string")
    assert M.compare_with_next(table).count() == 5
    assert M.compare_with_next(docs([])).collect() == []
