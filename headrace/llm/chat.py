"""Chat formatting by token-level assembly.

Each turn's segments are encoded on their own and joined with reserved ids that
lie above the vocabulary, so no text, whatever it says, can produce a control
token. The formatted string shows reserved ids as their control strings;
control strings occurring in a role or a text are escaped there: behind the
first character of a control string one backslash is put, also where backslashes
stand there already, and taken away again by ``unescape``; the escaping is
thereby reversible for every text.

A turn is ``<|turn|>`` role ``<|says|>`` text ``<|end|>``; a conversation starts
with ``<|begin|>``. The loss mask is the prefix sum of +1 at the first id of each
assistant text and -1 behind its ``<|end|>``: the model learns to end a turn, and
no header is trained on.

Rows are dealt to tasks by ranges of (conversation, turn, role, text) and written in
order as pieces of bounded rows and bytes, a short conversation as one. A turn lies
in one piece, so a piece's mask is its own prefix sum. A row ahead of every
conversation stands for its ``<|begin|>``. Equal rows travel as one with a count,
in shares of ``COPIES``, so neither a conversation nor a row repeated any number of
times meets in one task or row.

Defined cases: null texts and roles are empty; a null turn comes first; turns with
equal numbers are ordered by role, then text, and repeated rows are all kept; a
null conversation id is a conversation; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .text import blocks, bounded
from .tokens import Encoder, id_bytes

#: Control strings of the template, in the order of their reserved ids, and the role that is trained on.
RESERVED = ["<|begin|>", "<|turn|>", "<|says|>", "<|end|>"]
BEGIN, TURN, SAYS, END = range(4)
LEARN_FROM = "assistant"

# Control strings of common templates, escaped as well.
FOREIGN = [
    "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<|startoftext|>",
    "<|eot_id|>", "<|eom_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<|end_of_text|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
]
_CONTROL = re.compile("|".join(rf"(?:{re.escape(x[0])}(\\*){re.escape(x[1:])})" for x in sorted({*RESERVED, *FOREIGN})))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


class Template:
    """Ids of a byte-level vocabulary plus the reserved ones."""

    def __init__(self, file: str):
        self.code = Encoder(file, special=False)
        self.bytes = id_bytes(self.code.tokenizer)
        self.base = len(self.bytes)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()

    def turns(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """(role, text) of every turn of formatted ids."""
        out, at = [], {k: np.flatnonzero(ids == self.base + k) for k in (TURN, SAYS, END)}
        for a, b, c in zip(at[TURN].tolist(), at[SAYS].tolist(), at[END].tolist(), strict=True):
            out.append((unescape(self.decode(ids[a + 1 : b].tolist())), unescape(self.decode(ids[b + 1 : c].tolist()))))
        return out

    def learned(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """All text under the mask, unescaped stretch by stretch."""
        edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
        out = []
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            out.append(unescape(self.decode([i for i in ids[a:b].tolist() if i < self.base])))
        return "".join(out)


_TEMPLATES: dict[str, Template] = {}


def template(file: str) -> Template:
    if file not in _TEMPLATES:
        _TEMPLATES[file] = Template(file)
    return _TEMPLATES[file]


#: Turns and bytes of text in a piece (a longer turn is a piece alone), copies of a row in one share.
PIECE_ROWS, PIECE_BYTES, COPIES = 4096, 1 << 20, 256
_FORMATTED = "piece long, whole boolean, n_turns long, input_ids array<int>, loss_mask binary, formatted string"


def format_chats(rows: DataFrame, file: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Formatted conversations in pieces: its id, piece (ascending), whole (the only one), n_turns, input_ids, loss_mask (a byte per id), formatted."""
    bounded(rows)
    turns = rows.select(F.col(conv_id).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    same = turns.groupBy("c", "n", "r", "t").agg(F.count(F.lit(1)).alias("copies"))
    share = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}")))
    same = same.withColumn("i", share).select("c", F.lit(1).alias("k"), "n", "r", "t", "i", F.least(F.lit(COPIES), F.col("copies") - F.col("i") * COPIES).cast("int").alias("copies"))
    none = lambda name: F.lit(None).cast(dict(same.dtypes)[name]).alias(name)
    heads = turns.select("c").distinct().select("c", F.lit(0).alias("k"), *map(none, ("n", "r", "t", "i")), F.lit(0).alias("copies"))
    ordered = same.unionByName(heads).repartitionByRange("c", "k", "n", "r", F.left("t", F.lit(256)), "i").sortWithinPartitions("c", "k", "n", "r", "t", "i")
    schema = T._parse_datatype_string(f"c {dict(same.dtypes)['c']}, {_FORMATTED}")
    want = to_arrow_schema(schema)

    def scan(batches):
        to, base = template(file), TaskContext.get().partitionId() << 32
        marks = [np.array([to.base + k], np.int32) for k in (BEGIN, TURN, SAYS, END)]
        conv, first, cuts, made = None, True, 0, 0
        own = None  # ids, steps of the mask as (place, change), shown strings, turns, bytes, ids so far

        def out(whole):
            nonlocal made
            made += 1
            ids, places, shown, turns, _, size = own
            step = np.zeros(size + 1, np.int64)
            for a, b in places:
                step[a] += 1
                step[b] -= 1
            mask = np.cumsum(step)[:-1].astype(np.uint8)
            row = [[conv], [base + made], [whole], [turns], [np.concatenate(ids)], [mask.tobytes()], ["".join(shown)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, want, strict=True)], schema=want)

        def add(ids, learn, shown, turns, held):
            places = own[1]
            if learn is not None:
                places.append((own[5] + learn[0], own[5] + learn[1]))
            own[0].append(ids)
            own[2].append(shown)
            own[3] += turns
            own[4] += held
            own[5] += ids.size

        for batch in batches:
            for small in blocks(batch, "t"):
                roles, texts = ([escape(x or "") for x in small.column(i).to_pylist()] for i in (3, 4))
                heads, bodies = ([np.frombuffer(x, "<u4").astype(np.int32) for x in to.code.batch(y)] for y in (roles, texts))
                plain, kinds, copies = (small.column(i).to_pylist() for i in (3, 1, 6))
                for c, k, said, n, r, t, h, b in zip(small.column(0).to_pylist(), kinds, plain, copies, roles, texts, heads, bodies, strict=True):
                    if own is None or c != conv:
                        if own is not None:
                            # Only the first and the last conversation of a range may go on in another one.
                            yield out(not first and cuts == 0)
                            first, cuts = False, 0
                        conv, own = c, [[], [], [], 0, 0, 0]
                    if k == 0:
                        add(marks[0], None, RESERVED[BEGIN], 0, 0)
                        continue
                    ids = np.concatenate((marks[1], h, marks[2], b, marks[3]))
                    learn = (h.size + 2, ids.size) if said == LEARN_FROM else None
                    shown = f"{RESERVED[TURN]}{r}{RESERVED[SAYS]}{t}{RESERVED[END]}"
                    for _ in range(n):
                        if own[3] >= piece_rows or own[4] >= PIECE_BYTES:
                            yield out(False)
                            own, cuts = [[], [], [], 0, 0, 0], cuts + 1
                        add(ids, learn, shown, 1, len(shown))
        if own is not None:
            yield out(False)

    return ordered.mapInArrow(scan, schema).withColumnRenamed("c", conv_id)


def chat_digests(chats: DataFrame, file: str, conv_id: str = "conv_id") -> DataFrame:
    """Digests per conversation, read back from the ids, masks and formatted strings of its pieces.

    Pieces of long conversations stream through one task in order; one is held at a time.
    """
    kind = dict(chats.dtypes)[conv_id]
    key = to_arrow_schema(T._parse_datatype_string(f"c {kind}")).field("c").type
    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in fields.split(", ")]

    class Sums:
        def __init__(self):
            self.n, self.lost, self.chars = 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, said: str, n: int, lost: str, chars: int):
            self.n, self.lost, self.chars = self.n + n, self.lost + len(lost), self.chars + chars
            self.turns.update(said.encode())
            self.loss.update(lost.encode())

        def out(self):
            return [self.n, self.turns.hexdigest(), self.lost, self.loss.hexdigest(), self.chars]

    def read(batches):
        """Digests of whole conversations; of other pieces what was read from them."""
        to = template(file)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                ids = batch.column(3)[i].values.to_numpy()
                turns = to.turns(ids)
                lost = to.learned(ids, np.frombuffer(batch.column(4)[i].as_py(), np.uint8))
                said, chars = "".join(f"{r}\n{t}\n" for r, t in turns), len(batch.column(5)[i].as_py())
                whole = batch.column(2)[i].as_py()
                sums = Sums()
                if whole:
                    sums.add(said, len(turns), lost, chars)
                rows.append([*(sums.out() if whole else [len(turns), None, None, None, chars]), None if whole else said, None if whole else lost])
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], ["c", "piece", "whole", *names, "said", "lost"])

    def join(batches):
        conv, sums = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([conv], key), *map(pa.array, zip(sums.out()))], ["c", *names])  # noqa: B905

        for batch in batches:
            for c, n, chars, said, lost in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if sums is None or c != conv:
                    if sums is not None:
                        yield out()
                    conv, sums = c, Sums()
                sums.add(said, n, lost, chars)
        if sums is not None:
            yield out()

    chats = chats.select(F.col(conv_id).alias("c"), "piece", "whole", "input_ids", "loss_mask", "formatted")
    first = cut_lineage(chats.mapInArrow(read, f"c {kind}, piece long, whole boolean, {fields}, said string, lost string"))
    rest = first.filter("not whole").repartition("c").sortWithinPartitions("c", "piece").select("c", "n_turns", "formatted_chars", "said", "lost")
    return first.filter("whole").select("c", *names).unionByName(rest.mapInArrow(join, f"c {kind}, {fields}")).withColumnRenamed("c", conv_id)
