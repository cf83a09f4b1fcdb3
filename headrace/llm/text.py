"""Vectorised words, shingles and bounded batches for Arrow tasks.

Texts reach these helpers as Arrow string arrays and are handled as one byte
buffer with document bounds, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text handled at once inside a task; a longer document is handled alone.
BLOCK_BYTES = 1 << 20


def _mask(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


#: Bytes of words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (the latter after lower-casing).
NOT_SPACE = _mask(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = _mask(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)

_BYTE = np.random.default_rng(20_11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds of each text) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``limit`` text bytes, or one longer text."""
    _, bounds = bytes_of(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = NOT_SPACE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, byte start, byte end) of every word, and nothing across texts.

    Words are maximal runs of bytes for which ``inside`` holds after ``fold``.
    """
    none = np.zeros(0, np.int64)
    if data.size == 0:
        return none.astype(np.uint64), none, none
    data = fold[data]
    w = inside[data]
    cut = np.zeros(data.size + 1, bool)
    cut[bounds] = True
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    start = np.flatnonzero(w & (~before | cut[:-1]))
    if start.size == 0:
        return none.astype(np.uint64), none, none
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    end = np.flatnonzero(w & (~after | cut[1:])) + 1
    size = end - start
    at = np.flatnonzero(w)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    pos = np.arange(at.size) - np.repeat(first, size)
    value = _BYTE[data[at]] * powers(int(size.max()))[pos]
    h = np.add.reduceat(value, first)
    return mix(h + size.astype(np.uint64)), start, end


def word_bounds(start: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index of the first word of each text, and the number of words."""
    return np.searchsorted(start, bounds)


def shingles(h: np.ndarray, q: int) -> np.ndarray:
    """Hash of the ``q`` words from each position on (positions near the end are cut off by the caller)."""
    n = h.size - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for p, x in zip(powers(q + 1, np.uint64(0xD6E8FEB86659FD93))[1:], range(q), strict=True):
        out += h[x : x + n] * p
    return mix(out)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + n)``."""
    total = int(size.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def add_column(df: DataFrame, name: str, kind: str, column: str, fn: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``df`` with a column computed from blocks of at most ``BLOCK_BYTES`` of ``column``.

    A column of that name is replaced. Rows, their order within a partition and
    all other columns are kept.
    """
    bounded(df)
    kept = [c for c in df.columns if c.lower() != name.lower() or c == column]
    if column == name:
        raise ValueError(f"{name} is the text column")
    df = df.select(*[f"`{c.replace('`', '``')}`" for c in kept])
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    want = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, column):
                cols = [c.cast(f.type) if c.type != f.type else c for c, f in zip(part.columns, want, strict=False)]
                yield pa.RecordBatch.from_arrays([*cols, fn(part).cast(want.field(name).type)], schema=want)

    return df.mapInArrow(run, schema)


def bounded(df: DataFrame) -> None:
    """Arrow batches by bytes, not only by rows: documents can be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
