"""Token ids in binary files: patched frame-of-reference blocks.

A segment file holds whole documents. Its ids are cut into blocks of ``BLOCK`` ids. A block
stores its minimum once, the differences to it in as many bits as the 90th percentile
difference needs, and what does not fit in an exception list. An index of block starts gives
random access: ``read_range`` decodes only the blocks that a range of ids touches.

Layout, little-endian::

    "PFORIDS1" | u64 ids | u64 documents | u64 blocks
    i64 document id (documents) | u8 id is null (documents) | u64 start (documents + 1)
    u64 block start, relative to the first block (blocks + 1)
    block: u32 minimum | u8 width | u8 exceptions | packed low bits (16 * width bytes)
           | u8 position (exceptions) | u32 difference (exceptions)

Null texts are empty documents, which hold the end id only. Documents with a null id come
last; equal ids are in the order of a hash of their text. An empty table gives no segment.
Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlytics.llm.helpers import filesystem, write_file
from pitchlytics.storage import new_folder, settle

MAGIC = b"PFORIDS1"
HEAD = struct.Struct("<8sQQQ")
BLOCK = 128
PERCENTILE = 90
#: Ids at which a segment is closed: what a task holds before it writes.
SEGMENT_IDS = 2_000_000
END_ID = 2

MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"


# -- the format ---------------------------------------------------------------------------

def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The blocks of ``ids`` (uint32) and their starts, one more than blocks."""
    n = -(-len(ids) // BLOCK)
    if n == 0:
        return [], np.zeros(1, "<u8")
    padded = np.empty(n * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids):] = ids[-1]
    rows = padded.reshape(n, BLOCK)
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    chosen = np.sort(diff, axis=1)[:, BLOCK * PERCENTILE // 100 - 1]
    width = _widths(chosen)
    packed: list[bytes] = [b""] * n
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for part in np.array_split(at, -(-len(at) // 2048)):
            bits = ((diff[part][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            data = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
            for i, row in zip(part, data, strict=True):
                packed[i] = row.tobytes()
    over = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    count = over.sum(axis=1)
    where, position = np.nonzero(over)
    high, position = diff[where, position].astype("<u4"), position.astype(np.uint8)
    ends = np.cumsum(count)
    blocks = []
    for i in range(n):
        a, b = int(ends[i] - count[i]), int(ends[i])
        blocks.append(
            struct.pack("<IBB", int(low[i]), int(width[i]), b - a) + packed[i]
            + position[a:b].tobytes() + high[a:b].tobytes()
        )
    starts = np.zeros(n + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=starts[1:])
    return blocks, starts


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that begin at ``starts`` (the last is the end) of ``data``."""
    raw, at = np.frombuffer(data, np.uint8), starts[:-1].astype(np.int64)
    n = len(at)
    if n == 0:
        return np.zeros(0, np.uint32)
    low = raw[at[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, count = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
    out = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        for part in np.array_split(mine, -(-len(mine) // 2048)):
            if w:
                body = raw[at[part][:, None] + 6 + np.arange(16 * w)]
                bits = np.unpackbits(body, axis=1, bitorder="little").reshape(len(part), BLOCK, w)
                out[part] = bits @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    total = int(count.sum())
    if total:
        block = np.repeat(np.arange(n), count)
        nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        first = at[block] + 6 + 16 * width[block]
        position = raw[first + nth]
        values = raw[(first + count[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
        out[block, position] = values
    return (out + low[:, None]).ravel()


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    blocks, starts = encode_blocks(ids)
    begin = np.zeros(len(lengths) + 1, "<u8")
    np.cumsum(lengths, out=begin[1:])
    return b"".join((
        HEAD.pack(MAGIC, len(ids), len(doc_ids), len(blocks)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        begin.tobytes(), starts.tobytes(), *blocks,
    ))


def _index_bytes(docs: int, blocks: int) -> int:
    return docs * 9 + 8 * (docs + 1) + 8 * (blocks + 1)


def _index(data: bytes, docs: int, blocks: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    ids = np.frombuffer(data, "<i8", docs)
    null = np.frombuffer(data, np.uint8, docs, 8 * docs)
    begin = np.frombuffer(data, "<u8", docs + 1, 9 * docs)
    starts = np.frombuffer(data, "<u8", blocks + 1, 9 * docs + 8 * (docs + 1))
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], begin, starts


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their starts (one more than documents) and all ids."""
    magic, n_ids, docs, blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    doc_ids, begin, starts = _index(data[HEAD.size:HEAD.size + _index_bytes(docs, blocks)], docs, blocks)
    return doc_ids, begin, decode_blocks(data[HEAD.size + _index_bytes(docs, blocks):], starts)[:n_ids]


def read_range(url: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a segment, from its index and the blocks they lie in."""
    store, path = filesystem(url)
    with store.open_input_file(path) as f:
        _, n_ids, docs, blocks = HEAD.unpack(f.read(HEAD.size))
        start, stop = max(0, start), min(stop, n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        size = _index_bytes(docs, blocks)
        first, last = start // BLOCK, -(-stop // BLOCK)
        f.seek(HEAD.size + size - 8 * (blocks + 1) + 8 * first)
        starts = np.frombuffer(f.read(8 * (last - first + 1)), "<u8")
        f.seek(HEAD.size + size + int(starts[0]))
        data = f.read(int(starts[-1] - starts[0]))
    return decode_blocks(data, starts - starts[0])[start - first * BLOCK:stop - first * BLOCK]


# -- encoding text ------------------------------------------------------------------------

class Encoder:
    """Ids of whole texts by a tokenizers vocabulary, through a bounded memory of pieces.

    The vocabulary splits at white space before it merges, so a text's ids are those of its
    pieces between spaces and line ends, one after the other. Pieces that are a plain Latin
    word and an optional run of full stops and commas skip the normaliser, which leaves them
    as they are but for case; all others go through the library's whole chain.
    """

    MOST = 600_000
    LATIN = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and c != "İ")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        small = {c.lower() for c in self.LATIN}
        self.to_bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in small if not c.isascii()})
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            tokens = self.tokenizer.model.tokenize(word.translate(self.to_bytes))
            found = self.words[word] = np.array([t.id for t in tokens], "<u4").tobytes()
        return found

    def piece(self, piece: str) -> bytes:
        core = piece.rstrip(".,")
        if core and self.LATIN.issuperset(core):
            rest = piece[len(core):]
            ids = self.word(core.lower())
            return ids + self.mark(rest) if rest else ids
        return self.whole(piece)

    def mark(self, rest: str) -> bytes:
        return self.pieces.get(rest) or self.pieces.setdefault(rest, self.whole(rest))

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the whole text."""
        if len(self.pieces) > self.MOST:
            self.pieces.clear()
        if len(self.words) > self.MOST:
            self.words.clear()
        parts = text.replace("\n", " ").split(" ")
        for new in set(parts).difference(self.pieces):
            self.pieces[new] = self.piece(new) if new else b""
        return b"".join(map(self.pieces.__getitem__, parts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, made once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# -- writing and reading ------------------------------------------------------------------

def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, *, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write every document's ids and ``end_id`` in ascending order of id; one row per segment.

    Documents are range-partitioned by id, ties by a hash of the text, so that a hot id is
    split; each task writes its segments one after the other and holds one at a time. The
    returned manifest is a written table: the texts are encoded once."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("id").asc_nulls_last(), F.col("tie").asc()]
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, encode = TaskContext.get(), 0, encoder(tokenizer)
        part, attempt = task.partitionId(), task.taskAttemptId()
        end = np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            # A repeated task never writes over the files that a manifest names.
            url = f"{folder}/part-{part:05d}-{seq:05d}-{attempt}.pfor"
            data = encode_segment(doc_ids, lengths, np.frombuffer(b"".join(ids), "<u4"))
            write_file(url, data)
            row = [part], [seq], [url], [len(doc_ids)], [held], [len(data)]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3), strict=True)],
                ["part", "seq", "path", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = encode(text.as_py()) + end
                ids.append(found)
                doc_ids.append(doc_id)
                lengths.append(len(found) // 4)
                held += lengths[-1]
                if held >= segment_ids:
                    yield close()
                    ids, doc_ids, lengths, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield close()

    return settle(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the segments: ``doc_id``, ``start`` over all segments,
    ``n_tokens``, ``ids_crc32`` and, if asked for, the ``ids`` themselves."""
    # One small row per segment, so this window orders segments, not documents.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    at = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner = filesystem(path)
                with store.open_input_stream(inner) as f:
                    doc_ids, begin, ids = decode_segment(f.read())
                data, bounds = ids.astype("<u4").tobytes(), begin.astype(np.int64)
                pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                for i in range(0, len(pairs), 4096):
                    some = pairs[i:i + 4096]
                    columns = [
                        pa.array(doc_ids[i:i + 4096], pa.int64()),
                        pa.array([base + a for a, _ in some], pa.int64()),
                        pa.array([b - a for a, b in some], pa.int64()),
                        pa.array([zlib.crc32(data[4 * a:4 * b]) for a, b in some], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in some], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return at.repartition(parts, "path").mapInArrow(read, schema)
