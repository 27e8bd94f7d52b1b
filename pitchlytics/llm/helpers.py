"""Small helpers that several operators share: whole-text columns, files in the shared folder."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def hashable(kind: T.DataType) -> bool:
    """Whether values of a type can be hashed and grouped, which maps and variants can't."""
    return not any(x in kind.simpleString() for x in ("map<", "variant"))


#: The column that holds a boxed row.
ROW = "_row"


def boxed(docs: DataFrame) -> DataFrame:
    """All columns in one, ``ROW``, so that no column that an operator adds can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def unboxed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The boxed columns alone, as they were."""
    return rows.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in columns])


def filesystem(url: str) -> tuple[fs.FileSystem, str]:
    """The store behind ``url`` (a URI or an absolute path) and the path in it."""
    return fs.FileSystem.from_uri(url)


def write_file(url: str, data: bytes) -> None:
    """Write ``data`` under a temporary name and move it in place, so that a retried or a
    speculative task never leaves half a file."""
    store, path = filesystem(url)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, path)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]


def mixed64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of unsigned integers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_WORD_CODES: list[np.ndarray] = []


def word_codes(text: str) -> np.ndarray:
    """Per code point its lower-case letter or its digit, a space for all that is neither."""
    if not _WORD_CODES:
        table = np.full(0x10000, 32, np.uint32)
        for i in range(0x10000):
            c = chr(i)
            if c.isalnum():
                table[i] = ord(c.lower()[0])
        _WORD_CODES.append(table)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = codes >= 0x10000
    if not wide.any():
        return _WORD_CODES[0][codes]
    found = _WORD_CODES[0][np.where(wide, 32, codes)]
    for c in np.unique(codes[wide]):
        x = chr(int(c))
        if x.isalnum():
            found[codes == c] = ord(x.lower()[0])
    return found
