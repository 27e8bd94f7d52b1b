import inspect
import random

import corpus_pipeline as P
import pytest

from pitchlytics.llm import tokenfile
from pitchlytics.llm.workload import ORACLE, QUERIES, vocabulary

WORDS = {"en": ["the", "house", "which", "thing", "with", "though", "river"], "fr": ["été", "maison", "quelque", "chose", "avec", "rivière", "où"]}


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    rng = random.Random(3)
    texts, langs = [], []
    for i in range(90):
        lang = rng.choice(list(WORDS))
        texts.append(" ".join(w + str(rng.randint(0, 99)) if rng.random() < 0.5 else w for w in rng.choices(WORDS[lang], k=rng.randint(30, 80))))
        langs.append(lang)
    item = " ".join(rng.choices(WORDS["en"], k=30)) + " question"
    texts += [texts[0], texts[1] + " more", "before " + item + " after " + texts[2], None, "", "12 34 !!"]
    langs += [langs[0], langs[1], "en", None, "en", "en"]
    path = str(tmp_path_factory.mktemp("tables"))
    docs(texts, lang=langs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages_and_queries_are_as_dealt():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mix", "token_ids"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in P.STAGES)
    assert [f"op{n}_" for n in range(1, 11)] == [next(k for k in (f"op{n}_",) if any(q.startswith(k) for q in QUERIES)) for n in range(1, 11)]
    assert ORACLE.keys() <= QUERIES.keys()


def test_decisions_take_effect(spark, folder, tmp_path):
    path, texts = folder
    rows, stage = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = rows.columns
    for n, (name, f) in enumerate(P.STAGES):
        f(spark, rows, path).write.parquet(f"{tmp_path}/{n}")
        rows = spark.read.parquet(f"{tmp_path}/{n}")
        stage[name] = rows
        assert name == "token_ids" or rows.columns == columns
    ids = {name: sorted(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in stage.items()}
    assert ids["language_id"] == list(range(93))
    assert ids["near_dedup"] == [i for i in range(93) if i not in (90, 91)]
    assert ids["decontamination"] == list(range(90))
    taken = {i: ids["source_mix"].count(i) for i in range(90)}
    assert set(ids["source_mix"]) <= set(range(90)) and max(taken.values()) <= 2
    words = sum(len(texts[i].split()) * n for i, n in taken.items())
    assert abs(words / sum(len(texts[i].split()) for i in range(90)) - 1.5) < 0.02
    assert ids["token_ids"] == ids["source_mix"]
    encode = tokenfile.Encoder(vocabulary())
    got = stage["token_ids"].orderBy("start").collect()
    at = 0
    for r, i in zip(got, ids["source_mix"], strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(encode(texts[i])) // 4 + 1)
        at += r["n_tokens"]


def test_run_agrees_with_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, f in P.STAGES[1:]:
        docs = f(spark, docs.where("length(text) > 20"), folder[0]) if "text" in docs.columns else docs
    assert sorted(map(tuple, P.run(spark, folder[0]).collect())) == sorted(map(tuple, docs.collect()))


def test_empty_tables(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_clean_documents_survive_the_filters(spark, folder):
    """Without copies and leaks every document in a language passes the three filters."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS["en"], k=40)) + f" {i}", "en", "s", 0) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in P.STAGES[:3]:
        assert f(spark, table, folder[0]).count() == 30, name


CLASHING = ("lang_pred", "score", "_row", "_key", "_id", "_n", "key", "label", "leaks", "mix_size", "mix_note", "mix_pattern", "a.b")


def test_clashing_columns_nulls_and_repeated_rows(spark, docs, tmp_path):
    """Every filtering stage hands on all columns as they were, null ids and sources included."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS["en"], k=40)) + f" {i}" for i in range(20)]
    table = docs(texts, extra=CLASHING, doc_id=[None, *range(1, 20)], source=[None, None, *["s"] * 18], lang=[None, *["en"] * 19])
    spark.createDataFrame([(5, "another " * 20), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, before = table.union(table.where("doc_id = 3")), sorted(map(repr, table.collect()))
    for name, f in P.STAGES[:3]:
        f(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        assert (rows.columns, rows.dtypes) == (table.columns, table.dtypes)
        got = sorted(map(repr, rows.collect()))
        assert len(got) == (21 if name == "language_id" else 20) and sorted(set(got)) == before
    mixed = P.source_mix(spark, rows, str(tmp_path))
    assert mixed.columns == table.columns and set(map(repr, mixed.collect())) <= set(before)
    assert P.token_ids(spark, mixed, str(tmp_path)).count() == mixed.count()


def test_unlearned_scripts_and_letter_junk_go(spark, docs, folder):
    rng = random.Random(12)
    clean = [(" ".join(rng.choices(WORDS[x], k=40)), x) for x in ("en", "fr") for _ in range(60)]
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
    junk = [" ".join("".join(rng.choices(a, k=rng.randint(2, 9))) for _ in range(60)) for a in alphabets for _ in range(40)]
    table = docs([t for t, _ in clean] + junk, lang=[x for _, x in clean] + [None] * len(junk))
    assert sorted(r["doc_id"] for r in P.language_id(spark, table, folder[0]).collect()) == list(range(len(clean)))
