import base64
import gzip
import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from pitchlytics.llm import warc as W
from pitchlytics.llm.helpers import filesystem

SCHEMA = "page_id long, url string, html string, path string, offset long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def some(n=200):
    rng = random.Random(1)
    bodies = [None, "", "same", "<p>\r\n\r\n</p>", "é😀"] + [f"<html>{rng.random()}</html>" * rng.randint(1, 90) for _ in range(n)]
    rows = [(i, f"http://x/{i}?a= b\r\nX: y%20", t) for i, t in enumerate(bodies)]
    rows += [(n + 100 + i, None, rng.choice(bodies)) for i in range(150)]
    rng.shuffle(rows)
    return rows


def expected(rows, least=0):
    first = defaultdict(list)
    for i, _, t in rows:
        first[t or ""].append(i)
    for i, u, t in rows:
        raw = (t or "").encode()
        again = len(raw) >= least and i != min(first[t or ""])
        yield (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", min(first[t or ""]) if again else None)


COLUMNS = ("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip(spark, rows, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 5_000)
    data = some()
    index = W.write_archives(pages(spark, data).repartition(3))
    assert index.select("path").distinct().count() > 3
    assert rows(W.read_records(index), *COLUMNS) == sorted(expected(data))
    assert rows(index, *COLUMNS) == sorted(expected(data))
    body = {i: (t or "").encode() for i, _, t in data}
    for r in W.read_records(index).collect():
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == body[r["record_id"]]


def test_archives_are_plain_warc(spark):
    index = W.write_archives(pages(spark, [(1, "http://a b\n", "hi"), (2, None, "hi")]).coalesce(1)).orderBy("record_id").collect()
    store, path = filesystem(index[0]["path"])
    with store.open_input_file(path) as f:
        text = gzip.decompress(f.read()).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Target-URI: http://a%20b%0A\r\n" in text
    assert "WARC-Refers-To: <urn:record:1>" in text and text.count("\r\n\r\nhi\r\n\r\n") == 1


def test_small_payloads_are_all_responses(spark, rows):
    data = some(30)
    assert rows(W.read_records(W.write_archives(pages(spark, data), least=5)), *COLUMNS) == sorted(expected(data, least=5))


def test_selected_records_only(spark, rows):
    data = some(50)
    index = W.write_archives(pages(spark, data))
    got = W.read_records(index.where(F.col("record_id") % 7 == 0), with_payload=False)
    assert rows(got, "record_id") == sorted((i,) for i, *_ in data if i % 7 == 0)


def test_neighbours_are_one_request():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 20 + W.GAP_BYTES, 5), ("b", 0, 7), ("b", 7, W.REQUEST_BYTES + 1), ("b", 8 + W.REQUEST_BYTES, 1)]
    assert [(p, a, b, len(r)) for p, a, b, r in W.ranges(iter(rows))] == [
        ("a", 0, 15, 2), ("a", 20 + W.GAP_BYTES, 25 + W.GAP_BYTES, 1), ("b", 0, 7, 1), ("b", 7, 8 + W.REQUEST_BYTES, 1), ("b", 8 + W.REQUEST_BYTES, 9 + W.REQUEST_BYTES, 1)]
    assert list(W.ranges(iter([]))) == []


def test_null_and_repeated_ids(spark, rows):
    data = [(None, "u", "x"), (None, "u", "x"), (3, "u", "x"), (3, "u", "x"), (4, "u", "x"), (None, "u", "only")]
    got = sorted(W.read_records(W.write_archives(pages(spark, data))).select("record_id", "record_type", "refers_to").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(None, "revisit", 3)] * 2 + [(3, "response", None)] * 2 + [(4, "revisit", 3), (None, "response", None)], key=str)


def test_empty_table(spark):
    index = W.write_archives(pages(spark, []))
    assert index.collect() == [] and W.read_records(index).collect() == []
