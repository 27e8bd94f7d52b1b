import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlytics.llm import languages as L
from pitchlytics.llm.workload import held_out


def profile(text):
    """One text's profile by the definition: the sum of products of permuted letter vectors."""
    spaced = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    while "  " in spaced:
        spaced = spaced.replace("  ", " ")
    total = np.zeros(L.DIMENSIONS)
    for i in range(len(spaced) - 2):
        a, b, c = (L.letter_vector(ord(x)).astype(float) for x in spaced[i:i + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


TEXTS = ["hello World", "", " ", "a", "É 1é!", "日本語 text", "x\ny  z", "\U00010400\U00010428", "ab" * 300, "İi", "1234"]


def test_profiles_are_the_definition():
    assert np.array_equal(L.profiles(TEXTS), np.stack([profile(t) for t in TEXTS]))


def test_large_alphabets_take_the_sorting_way(monkeypatch):
    expected = L.profiles(TEXTS)
    monkeypatch.setattr(L, "TABLE", 1)
    assert np.array_equal(L.profiles(TEXTS), expected)


@pytest.mark.parametrize("common", [0, 2, 10**6])
def test_rare_and_common_grams_add_up_alike(monkeypatch, common):
    texts = TEXTS * 5 + [chr(0x4E00 + i) * 3 for i in range(50)]
    expected = np.stack([profile(t) for t in texts])
    monkeypatch.setattr(L, "COMMON", common)
    monkeypatch.setattr(L, "BLOCK", 7)
    assert np.array_equal(L.profiles(texts), expected)
    monkeypatch.setattr(L, "TABLE", 1)
    assert np.array_equal(L.profiles(texts), expected)


@pytest.mark.parametrize("alphabet, length", [(range(0x4E00, 0x9000), 20), (range(97, 123), 10)])
def test_many_short_texts_need_little_memory(alphabet, length):
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice(alphabet)) for _ in range(length)) for _ in range(10_000)]
    L.letters(texts)
    tracemalloc.start()
    for a, b in L.chunks(texts):
        L.profiles(texts[a:b])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400 << 20


def test_letter_vectors_are_nearly_orthogonal_and_fixed():
    a, b = L.letter_vector(ord("a")).astype(int), L.letter_vector(ord("b")).astype(int)
    assert abs(a @ b) / L.DIMENSIONS < 0.15 and set(a) == {-1, 1}
    L._LETTERS.clear()
    assert np.array_equal(a, L.letter_vector(ord("a")))


def sentences(rng, words, n):
    return [" ".join(rng.choices(words, k=rng.randint(4, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def two(docs):
    rng = random.Random(1)
    ones = sentences(rng, ["the", "house", "which", "thing", "with", "though"], 150)
    others = sentences(rng, ["der", "schön", "nicht", "einfach", "über", "pferd"], 150)
    return docs(ones + others, lang=["en"] * 150 + ["de"] * 150, extra=("lang_pred",))


def test_learn_is_the_sum_of_profiles(two):
    got = L.learn(two.repartition(5))
    rows = two.select("text", "lang").collect()
    for lang in ("de", "en"):
        assert np.array_equal(got[lang], sum(profile(r["text"]) for r in rows if r["lang"] == lang))


def test_held_out_accuracy_and_score(two):
    table = two.withColumn("held", held_out())
    judged = L.predict(table, L.learn(table.where("NOT held")))
    assert judged.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    row, prototypes = judged.first(), L.learn(table.where("NOT held"))
    vector, best = profile(row["text"]), prototypes[row["lang_pred"]]
    assert row["score"] == pytest.approx(vector @ best / np.linalg.norm(vector) / np.linalg.norm(best), abs=1e-5)


def test_label_source_and_id_do_not_matter(two):
    prototypes = L.learn(two)
    plain = L.predict(two, prototypes).select("text", "lang_pred", "score")
    changed = L.predict(two.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("z"), "doc_id": -F.col("doc_id")}), prototypes)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, changed.select("text", "lang_pred", "score").collect()))


def test_unknown_and_degenerate(docs, rows):
    odd = docs([None, "", "12 !", "the house"], lang=[None, "en", "en", "en"])
    got = rows(L.predict(odd, L.learn(odd)), "doc_id", "lang_pred", "score")
    assert [(a, b) for a, b, _ in got] == [(0, "und"), (1, "und"), (2, "und"), (3, "en")] and all(0 <= s <= 1 for *_, s in got)
    assert rows(L.predict(odd, {}), "lang_pred", "score") == [("und", 0.0)] * 4
    assert L.learn(docs([])) == {} and L.predict(docs([]), {}).collect() == []
    with pytest.raises(ValueError, match="languages"):
        L.learn(docs(["a", "b", "c"], lang=["x", "y", "z"]), max_languages=2)


def test_held_out_rule(docs):
    import zlib

    got = dict(docs(["a"] * 40).select("doc_id", held_out()).collect())
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(40)}
