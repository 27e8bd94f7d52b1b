import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlytics.llm import nearcopies as N
from pitchlytics.llm.components import components


def weighted(text):
    """Weighted shingles from words, without the operator's arrays."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    size = min(5, len(words))
    counts = Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if words else {}
    return {s: 1 + np.log(n) for s, n in counts.items()}


def jaccard(a, b):
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in a.keys() & b.keys())


def union_find(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(x) for x in range(n)]


def brute(texts, least=0.8):
    """Classes from the similarity of all pairs."""
    number = {}
    sets = [{number.setdefault(k, len(number)): v for k, v in weighted(t).items()} for t in texts]
    arrays = [(np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)])) for s in sets]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
             if (texts[i] or "") == (texts[j] or "") or N.similarity(arrays[i], arrays[j]) >= least - 1e-9]
    return union_find(len(texts), links)


def test_similarity_is_the_definition():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ({k: 1 + np.log(rng.randint(1, 4)) for k in rng.sample(range(30), rng.randint(1, 25))} for _ in range(2))
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert N.similarity(*arrays) == pytest.approx(jaccard(a, b))


def test_registers_agree_with_the_probability_of_the_similarity():
    rng = random.Random(3)
    errors = []
    for n in (1, 3, 40, 700):
        for _ in range(15):
            base = [f"w{rng.randint(0, 10**6)}" for _ in range(n + 4)]
            other = [w if rng.random() > 0.03 else "new" + w for w in base]
            sets = [N.shingles(" ".join(x)) for x in (base, other)]
            signs = [N.signature(e, N.weights(c)) for e, c in sets]
            s = N.similarity(*[(e, N.weights(c)) for e, c in sets])
            errors.append((signs[0] == signs[1]).mean() - s)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_weights_shift_the_registers():
    elements = N.shingles("a b c d e f g h i j")[0]
    heavy = np.ones(len(elements))
    heavy[2] = 50
    sign = N.signature(elements, heavy)
    own = np.uint32(elements[2] >> np.uint64(32)).view(np.int32)
    assert (sign == own).mean() > 0.8


def test_words_ignore_case_and_marks():
    assert np.array_equal(N.shingles("The  Cat,sat!\non THE mat")[0], N.shingles("the cat sat on the mat")[0])
    assert len(N.shingles("x" * 10_000 + " y")[0]) == 1 and N.shingles(" ?! ")[0].size == 0
    assert not np.array_equal(N.shingles("x" * 9_000)[0], N.shingles("x" * 9_001)[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed, rows):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)] + [(5, 5)]
    got = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    expected = union_find(230, links)
    assert got == {x: expected[x] for pair in links for x in pair}


def corpus():
    """Chains, stars, near misses, copies, short and empty texts."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(30, 120))
        texts.append(" ".join(base))
        chain = base[:]
        for _ in range(4):  # each near its predecessor, the ends far apart
            chain = chain[:]
            chain[rng.randrange(len(chain))] = rng.choice(words)
            texts.append(" ".join(chain))
        texts.append(" ".join(base[: len(base) // 2] + rng.choices(words, k=len(base) // 2)))
    base = rng.choices(words, k=80)
    texts += [" ".join(base[:i] + [f"v{i}"] + base[i + 1:]) for i in range(0, 80, 2)]
    texts += [texts[0]] * 5 + [texts[1].upper(), None, "", None, "?!", "!?", "one", "One.", "one two", "one two", "a a a a a a a a"]
    texts.append("\n".join(["the same line again and again"] * 30) + " " + " ".join(base[:20]))
    texts.append("\n".join(["the same line again and again"] * 31) + " " + " ".join(base[:20]))
    rng.shuffle(texts)
    return texts


def test_classes_against_brute_force(docs, rows):
    texts = corpus()
    got = rows(N.classed(docs(texts, extra=("key", "node", "label", "registers"))), "doc_id", "class_id", "class_size")
    expected = brute(texts)
    assert [c for _, c, _ in got] == expected
    assert [n for _, _, n in got] == [expected.count(c) for c in expected]


def test_second_round_joins_what_the_first_leader_misses(spark, rows):
    """Members of one bucket that are far from its leader but near each other meet in blocks; a
    block tells fewer links than it has members, and a pair is judged in its first band only."""
    ones, gram, often = [1] * N.REGISTERS, np.arange(20, dtype=np.uint32), b""
    other = [2] * N.ROWS + ones[N.ROWS:]
    row = lambda bucket, band, node, label, registers, major, blocks, g=gram: (bucket, band, node, label, registers, g.tobytes(), often, major, blocks)
    table = [row("b", 0, i, i, [100 + i] * N.REGISTERS, False, 1) for i in range(3)]
    table += [row("b", 0, 9, 9, ones, True, 1), row("b", 0, 10, 10, ones, False, 1), row("b", 0, 12, 12, ones, False, 1, gram + 50)]
    table += [row("c", 0, 30, 30, ones, False, 3), *[row("c", 0, 40 + i, 40, ones, True, 3) for i in range(40)]]
    table += [row("d", 1, 90, 90, ones, True, 1), row("d", 1, 91, 91, ones, False, 1), row("e", 1, 95, 95, ones, True, 1), row("e", 1, 96, 96, other, False, 1)]
    schema = "bucket string, band int, node long, label long, registers array<int>, grams binary, often binary, major boolean, blocks long"
    got = rows(N.linked_in_blocks(spark.createDataFrame(table, schema), 0.8))
    assert (9, 10) in got and (95, 96) in got
    assert all(a == 30 and 40 <= b < 80 for a, b in got if (a, b) not in ((9, 10), (95, 96)))
    assert 1 <= len(got) - 2 <= 3  # one link per block of c that has members


def test_many_copies_far_from_each_other(docs, rows):
    """A group of copies whose original is not the least id, and whose members differ."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(120):
        copy = base[:]
        for at in rng.sample(range(100), 2):
            copy[at] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    texts.insert(70, " ".join(base))
    got = rows(N.classed(docs(texts)), "doc_id", "class_id")
    assert [c for _, c in got] == brute(texts)


def test_one_of_each_keeps_whole_rows(spark, docs):
    texts = corpus()
    table = docs(texts, extra=("_x",))
    kept = N.one_of_each(table)
    expected = brute(texts)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "x"), (3, "x"), (3, "y"), (None, None), (2, "")], "doc_id long, text string")
    left = sorted(((r["doc_id"], r["text"]) for r in N.one_of_each(odd).collect()), key=str)
    assert left == sorted([(None, "a b c"), (3, "x"), (3, "y"), (2, "")], key=str)


def test_empty_table(docs):
    assert N.classed(docs([])).collect() == [] and N.one_of_each(docs([])).collect() == []
    assert N.classed(docs([None, "?"])).agg(F.count_distinct("class_id")).first()[0] == 2
