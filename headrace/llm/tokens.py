"""Token-id files: independent zstandard frames, a trailing seek table, checksums per frame.

File layout (all integers little-endian):

* data frames: ordinary zstandard frames, each of ``FRAME_IDS`` unsigned 32-bit
  ids (the last one fewer), cut without regard to documents;
* one skippable frame (magic 0x184D2A50) with a zstandard frame inside: the
  documents' ids, a byte each that is 0 for a null id, and their lengths;
* the seek table of the seekable format: a skippable frame (magic 0x184D2A5E)
  with compressed size, decompressed size and checksum (low 32 bits of XXH64 of
  the decompressed bytes) per frame, then the number of frames, a descriptor
  byte and the magic 0x8F92EAB1.

Any zstandard decoder reads the ids as a stream; a reader that wants a few
documents reads the table, then only the frames those documents lie in.

Rows are dealt to files by ranges of ``doc_id`` and sorted inside a task, so
files in order hold ascending ids. A task writes to a name of its own and the
manifest, a Spark table, lists the files of tasks that succeeded: a task that
is run again leaves an unlisted file, never a wrong one.

Defined cases: a null text is an empty document (only the end id); null ids come
first; rows with the same id are all written, ordered by a hash of the text; the
string of a special token in a text becomes its id, as the library has it; an empty table gives an empty manifest; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder
from .text import blocks, bounded

#: Ids per data frame, zstandard level, id that ends a document, entries of each cache of a worker.
FRAME_IDS, LEVEL, END_ID, CACHE = 1 << 16, 3, 0, 200_000
SKIP_INDEX, SKIP_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


#: Marks that end a word and are a piece of their own there.
MARKS = frozenset(",.;:!?)]}\"")

# The pre-tokeniser's pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of whole texts, as the library gives them with ``add_special_tokens=False``.

    Texts that hold the string of a special token go to the library as they are;
    with ``special=False`` such strings are ordinary text.

    The pre-tokeniser's pieces are encoded one by one, so equal pieces are given
    to the tokenizer's model once and kept. The pre-tokeniser never joins what
    stands before a single space with what follows if neither neighbour of the
    space is white space: such texts are split at their spaces, and the ids of
    whole words with what clings to them are kept as well; the same holds for a
    single line feed, and a mark behind a word is a piece of its own. Each cache
    has two generations of ``CACHE`` entries: what is still in use outlives the other.
    """

    def __init__(self, file: str, special: bool = True):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.tokenize = self.tokenizer.model.tokenize
        self.split = regex.compile(PATTERN).findall
        self.letters = {b: c for c, b in byte_letters().items()}
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_chunks, self.old_pieces = self.chunks, self.pieces

    def piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            got = self.old_pieces.get(p)
            if got is None:
                got = array("I", [t.id for t in self.tokenize(p.encode().decode("latin-1").translate(self.letters))]).tobytes()
            if len(self.pieces) >= CACHE:
                self.pieces, self.old_pieces = {}, self.pieces
            self.pieces[p] = got
        return got

    def text(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def word(self, c: str) -> bytes:
        """Ids of a space and ``c``."""
        if c.isalpha():
            return self.piece(" " + c)
        if c[-1:] in MARKS and c[:-1].isalpha():
            return self.piece(" " + c[:-1]) + self.piece(c[-1])
        if "\n" in c:
            first, *rest = c.split("\n")
            if all(x and x == x.strip() for x in (first, *rest)):
                return self.chunk(first) + b"".join([self.piece("\n") + (self.piece(x) if x.isalpha() else self.text(x)) for x in rest])
        return self.text(" " + c)

    def chunk(self, c: str) -> bytes:
        got = self.chunks.get(c)
        if got is None:
            got = self.old_chunks.get(c)
            if got is None:
                got = self.word(c)
            if len(self.chunks) >= CACHE:
                self.chunks, self.old_chunks = {}, self.chunks
            self.chunks[c] = got
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        cut = text.split(" ")
        # strip() gives back the same object where no white space stands beside a space.
        if "" in cut or cut != list(map(str.strip, cut)):
            return self.text(text)
        ids = list(map(self.chunks.get, cut))
        ids[0] = self.text(cut[0])
        if None in ids:
            ids = [self.chunk(c) if i is None else i for c, i in zip(cut, ids, strict=True)]
        return b"".join(ids)

    def batch(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode, texts))


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def id_bytes(tokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    back = byte_letters()
    vocab = tokenizer.get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for word, i in vocab.items():
        out[i] = bytes(back[c] for c in word)
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


class FrameWriter:
    """Writes one file; memory holds one frame and the documents' lengths."""

    def __init__(self, out):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=LEVEL)
        self.buffer, self.held, self.frames = [], 0, []
        self.ids, self.sizes, self.total = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= 4 * FRAME_IDS:
            data = b"".join(self.buffer)
            whole = len(data) - len(data) % (4 * FRAME_IDS)
            for i in range(0, whole, 4 * FRAME_IDS):
                self._frame(data[i : i + 4 * FRAME_IDS])
            self.buffer, self.held = [data[whole:]], len(data) - whole

    def _frame(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._frame(b"".join(self.buffer))
        known = np.array([x is not None for x in self.ids], np.uint8)
        index = struct.pack("<Q", len(self.ids)) + np.array([x or 0 for x in self.ids], "<i8").tobytes() + known.tobytes() + np.array(self.sizes, "<u8").tobytes()
        packed = self.pack.compress(index)
        self.out.write(struct.pack("<II", SKIP_INDEX, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *f) for f in [*self.frames, (len(packed) + 8, 0, 0)])
        n = len(self.frames) + 1
        self.out.write(struct.pack("<II", SKIP_SEEK, len(table) + 9) + table + struct.pack("<IBI", n, 0x80, SEEK_MAGIC))


class FrameReader:
    """Reads documents of one file, decompressing only the frames they lie in."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.sizes, self.sums = table[:-1].T
        self.starts = np.concatenate(([0], np.cumsum(self.packed)))
        self.unpack = zstandard.ZstdDecompressor()
        index = self.unpack.decompress(self._at(int(self.starts[-1]) + 8, int(table[-1, 0]) - 8))
        m = struct.unpack_from("<Q", index)[0]
        self.ids = np.frombuffer(index, "<i8", m, 8)
        self.known = np.frombuffer(index, np.uint8, m, 8 + 8 * m).astype(bool)
        self.ends = np.cumsum(np.frombuffer(index, "<u8", m, 8 + 9 * m).astype(np.int64))
        self.begins = self.ends - np.frombuffer(index, "<u8", m, 8 + 9 * m).astype(np.int64)
        self.read_frames, self._last = 0, (-1, b"")

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        if self._last[0] != i:
            data = self.unpack.decompress(self._at(int(self.starts[i]), int(self.packed[i])))
            if len(data) != self.sizes[i] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
                raise ValueError(f"frame {i} is damaged")
            self.read_frames += 1
            self._last = (i, data)
        return self._last[1]

    def pieces(self, k: int) -> Iterator[bytes]:
        """Bytes of the ids of the k-th document, frame by frame."""
        a, b = int(self.begins[k]), int(self.ends[k])
        for i in range(a // FRAME_IDS, -(-b // FRAME_IDS)):
            base = i * FRAME_IDS
            yield self.frame(i)[4 * max(a - base, 0) : 4 * min(b - base, FRAME_IDS)]

    def document(self, k: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(k)), "<u4")

    def find(self, doc_id: int) -> np.ndarray:
        """Places of the documents with this id."""
        return np.flatnonzero(self.known & (self.ids == doc_id))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_token_files(docs: DataFrame, folder: str, file: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents; returns the manifest (part, path, n_docs, n_ids)."""
    bounded(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("tie", F.xxhash64("t")).repartitionByRange("d", "tie").sortWithinPartitions("d", "tie").select("d", "t")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        code, first = encoder(file), next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            to = FrameWriter(out)
            for batch in itertools.chain([first], batches):
                for small in blocks(batch, "t", 2 << 20):
                    for d, ids in zip(small.column(0).to_pylist(), code.batch(small.column(1).to_pylist()), strict=True):
                        to.add(d, ids + end)
            to.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [f"{folder}/{name}"], "n_docs": pa.array([len(to.ids)], pa.int64()), "n_ids": pa.array([to.total], pa.int64())})

    return cut_lineage(rows.mapInArrow(run, "part long, path string, n_docs long, n_ids long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, n_frames (frames of its file).

    ``start`` counts the ids of all documents before it. Files are dealt to
    tasks singly; only the manifest, a row per file, is summed in order.
    """
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).select("path", "base")
    files = files.repartition(max(1, manifest.count()), "path")

    def run(batches):
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, local = file_system(path)
                with fs.open_input_file(local) as f:
                    r = FrameReader(f)
                    for a in range(0, r.ids.size, 4096):
                        own = range(a, min(a + 4096, r.ids.size))
                        sums = []
                        for k in own:
                            c = 0
                            for piece in r.pieces(k):
                                c = zlib.crc32(piece, c)
                            sums.append(c)
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(r.ids[own.start : own.stop], pa.int64(), mask=~r.known[own.start : own.stop]),
                            "start": pa.array(r.begins[own.start : own.stop] + base), "n_tokens": pa.array((r.ends - r.begins)[own.start : own.stop]),
                            "ids_crc32": pa.array(sums, pa.int64()), "n_frames": pa.array(np.full(len(own), r.packed.size), pa.int64()),
                        })

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_frames long")


def token_output(docs: DataFrame, file: str, folder: str | None = None, **names) -> DataFrame:
    """Write all documents to ``folder`` (default: a new one in the shared folder) and read them back."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, file, **names))
