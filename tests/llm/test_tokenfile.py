import random
import zlib

import numpy as np
import pytest

from pitchlytics.llm import tokenfile as K
from pitchlytics.llm.workload import vocabulary


@pytest.mark.parametrize("ids", [
    [], [0], [2**32 - 1], [5] * 128, list(range(300)), [7] * 127 + [2**31], [0, 2**32 - 1] * 200,
    list(np.random.default_rng(1).integers(0, 50_000, 1000)), list(np.random.default_rng(2).zipf(1.3, 4000) % 2**32),
])
def test_blocks_round_trip(ids, tmp_path):
    ids = np.array(ids, np.uint32)
    lengths = [len(ids) // 3, 0, len(ids) - len(ids) // 3]
    data = K.encode_segment([4, None, -9], lengths, ids)
    doc_ids, begin, back = K.decode_segment(data)
    assert doc_ids == [4, None, -9] and begin.tolist() == [0, lengths[0], lengths[0], len(ids)] and np.array_equal(back, ids)
    path = tmp_path / "x.pfor"
    path.write_bytes(data)
    for a, b in [(0, len(ids)), (1, 2), (100, 140), (127, 129), (len(ids) - 1, len(ids) + 9), (5, 5)]:
        assert np.array_equal(K.read_range(str(path), a, b), ids[max(0, a):b])


def test_outliers_do_not_widen_a_block():
    ids = np.array([3] * 120 + [2**30] * 8, np.uint32)
    blocks, _ = K.encode_blocks(ids)
    assert len(blocks) == 1 and len(blocks[0]) == 6 + 8 * 5


WORDS = ["the", "Über", "naïve", "don't", "x,", "...", "it's", "42", "3.14", "a.b", "<|endoftext|>", "İstanbul", "ΣΑΣ", "ﬁne", "é",
         "日本語", "😀", "re.", "'ve", "word,.", "Ω", "ŉ", "ª", "ǅ", "K", " x", "tab\tx", "cr\rx", " y", "ý.", ",.,", "Œuvre."]


def test_pieces_give_the_library_ids():
    encode = K.Encoder(vocabulary())
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", "\n", "  ", "\n\n", ""]) for _ in range(rng.randint(0, 12)))
        assert encode(text) == encode.whole(text), repr(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(K.Encoder, "MOST", 3)
    encode = K.Encoder(vocabulary())
    for i in range(20):
        text = f"word{'x' * i} other{'y' * i}, third."
        assert encode(text) == encode.whole(text)
        assert len(encode.pieces) < 12


def expected(texts):
    whole = K.Encoder(vocabulary()).whole
    start = 0
    for i, t in enumerate(texts):
        ids = whole(t or "") + np.array([2], "<u4").tobytes()
        yield i, start, len(ids) // 4, zlib.crc32(ids)
        start += len(ids) // 4


def test_written_files_give_back_every_document(docs, rows):
    texts = ["Hello, world.", None, "", "hello " * 5000, "a b c"] + [f"text number {i}" for i in range(60)]
    manifest = K.write_tokens(docs(texts, extra=("ids", "tie", "id")).repartition(5), vocabulary(), segment_ids=50)
    assert manifest.count() > 5
    assert rows(K.read_tokens(manifest), "doc_id", "start", "n_tokens", "ids_crc32") == list(expected(texts))
    longest = K.read_tokens(manifest, with_ids=True).where("doc_id = 3").first()
    assert len(longest["ids"]) == longest["n_tokens"] and longest["ids"][-1] == 2


def test_null_and_repeated_ids_come_last_and_together(spark):
    table = spark.createDataFrame([(None, "z"), (1, "b"), (1, "b"), (0, "a"), (None, "y")], "doc_id long, text string")
    got = K.read_tokens(K.write_tokens(table, vocabulary())).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [0, 1, 1, None, None] and [r["start"] for r in got] == [0, 2, 4, 6, 8]


def test_empty_table(docs):
    assert K.read_tokens(K.write_tokens(docs([]), vocabulary())).collect() == []
