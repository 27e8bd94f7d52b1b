import random

import numpy as np
import pytest

from pitchlytics.llm import decontaminate as D


def best(item, text):
    """Least edits from the item to any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[at] = rng.choice("abcxyz")
        elif kind < 0.7:
            out.insert(at, rng.choice("abcxyz"))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(n))


def test_compared_characters_know_their_place():
    codes, at = D.compared("  Élan, VITAL!\n(42) ")
    assert "".join(map(chr, codes)) == "élan vital 42" and at.tolist()[0] == 2 and "  Élan, VITAL!\n(42) "[at[-1]] == "2"


@pytest.mark.parametrize("seed", range(6))
def test_finds_exactly_what_the_full_table_finds(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(6, 30))) for i in range(6)]
    index = D.Items(items)
    for _ in range(40):
        text = prose(rng, rng.randint(0, 30))
        if rng.random() < 0.8:
            i, item = rng.choice(items)
            most = D.budget(len(item), D.RATE)
            text += " " + edited(rng, item, rng.randint(0, 2 * most)) + " " + prose(rng, rng.randint(0, 20))
        codes = "".join(map(chr, D.compared(text)[0]))
        expected = {i: e for i, item in items if (e := best(item, codes)) <= D.budget(len(item), D.RATE)}
        got = {}
        for i, a, b, e in index.find(text):
            got[i] = min(e, got.get(i, e))
            own = "".join(map(chr, D.compared(text[a:b])[0]))
            assert best(own, items[i][1]) <= e + 2 and a < b <= len(text)
        assert got == expected


def test_every_occurrence_is_told():
    rng = random.Random(1)
    item = prose(rng, 20)
    text = f"{item.upper()}. {prose(rng, 10)} {edited(rng, item, 3)}\n{prose(rng, 9)}: {item}"
    found = D.Items([(7, item)]).find(text)
    assert [f[0] for f in found] == [7, 7, 7] and found[0][1:] == (0, len(item), 0) and found[2][2:] == (len(text), 0)


def test_repetitive_texts_and_items():
    index = D.Items([(1, "the " * 40), (2, "a b " * 30 + "end")])
    assert any(f[0] == 1 for f in index.find("the " * 500)) and index.find("teh " * 500) == []
    assert D.Items([]).find("x") == [] and D.Items([(1, "short"), (2, "")]).find("short") == []


def test_alignment_against_the_full_table():
    rng = random.Random(9)
    for _ in range(200):
        item, text = prose(rng, 4), prose(rng, 6)
        a, t = (np.array([ord(c) for c in x], np.int64) for x in (item, text))
        got = D.align(a, t, -len(item), len(text), 10**6)
        assert got[0] == best(item, text)


def test_tables_with_odd_rows(spark, docs, rows):
    rng = random.Random(2)
    item = prose(rng, 25)
    bench = spark.createDataFrame([(1, item, 0), (1, item, 1), (None, prose(rng, 25), 2), (3, None, 3), (4, "", 4)], "item_id long, text string, doc_id long")
    table = docs([f"x {item} y", None, "", prose(rng, 50), "long " * 20_000 + item], extra=("leaks", "start", "item_id"))
    found = D.find_leaks(table, bench)
    assert rows(found, "doc_id", "item_id", "start", "stop", "edits") == [
        (0, 1, 2, 2 + len(item), 0)] * 2 + [(4, 1, 100_000, 100_000 + len(item), 0)] * 2
    blocked = D.find_leaks(table, bench, block_chars=40)
    assert rows(blocked) == rows(found)
    clean = D.without_leaks(table, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 3] and clean.columns == [c for c in table.columns if c != "leaks"]
    assert D.without_leaks(table, bench.limit(0)).count() == 5 and D.find_leaks(docs([]), bench).collect() == []
