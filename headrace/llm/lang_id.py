"""Language identification by compression with a dictionary per language.

Each language is a raw-content zstandard dictionary of labelled text. A text is
folded to lower-case letters and single spaces, cut into stretches of at most
``STRETCH`` bytes at spaces, and every stretch is compressed with each
dictionary; the language with the smallest total wins. The margin to the second
is relative to the second; a text is rejected where it is below ``MARGIN``.

The dictionaries are the only thing learned, from at most ``SAMPLE`` labelled
texts a language, those of ``SAMPLE_BYTES`` before shorter and longer ones, else in
the order of a hash of the id, until ``DICTIONARY`` bytes are full: the bound on
labelled rows.

Defined cases: a text without a letter (null or empty too) is ``und`` with score
0 and rejected; languages that tie are taken in order of their name; a null
language or text teaches nothing; without labelled rows all is ``und``; repeated
rows are judged row by row; other columns pass through, one called like the
result is replaced.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import add_column

#: Bound of the fit: texts a language, least and most bytes of a text that is taken first, bytes a dictionary. Then bytes of a stretch, zstandard level, least margin.
SAMPLE, SAMPLE_BYTES, DICTIONARY, STRETCH, LEVEL, MARGIN = 120, (200, 4000), 160_000, 4096, 9, 0.02
UNKNOWN = "und"

#: Marks stay with their letters, numbers of any form go.
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def fold(text: str | None) -> str:
    """Lower-case letters and single spaces; empty without a letter."""
    folded = _NOT_LETTERS.sub(" ", text or "").strip().lower()
    return folded if folded[:1].isalpha() or _LETTER.search(folded) else ""


def dictionaries(docs: DataFrame, labelled: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """Dictionary content per language from a bounded sample of the labelled rows."""
    rows = docs.filter(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull())
    order = Window.partitionBy("lang").orderBy("far", "h", "t")
    few = (
        rows.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string"), F.lit("sample")).alias("h"), (~F.octet_length(text).between(*SAMPLE_BYTES)).alias("far"), F.substring(text, 1, DICTIONARY).alias("t"))
        .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE).toPandas()
    )
    out = {}
    for name, g in few.sort_values(["lang", "r"]).groupby("lang"):
        parts = [fold(t).encode() for t in g["t"]]
        content = b" ".join(p for p in parts if p)[:DICTIONARY]
        if len(content) >= 8:
            out[name] = content
    return out


def stretches(data: bytes) -> list[bytes]:
    out, at = [], 0
    while len(data) - at > STRETCH:
        end = data.rfind(b" ", at + 1, at + STRETCH)
        end = at + STRETCH if end < 0 else end
        out.append(data[at:end])
        at = end
    return [*out, data[at:]]


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.names = sorted(content)
        self.packers = []
        for n in self.names:
            d = zstandard.ZstdCompressionDict(content[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> dict:
        folded = fold(text)
        if not folded or not self.names:
            return {"lang": UNKNOWN, "score": 0.0, "rejected": True}
        parts = stretches(folded.encode())
        sizes = [sum(len(p.compress(x)) for x in parts) for p in self.packers]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = 1 - sizes[best] / min(rest) if rest else 1.0
        return {"lang": self.names[best], "score": margin, "rejected": margin < MARGIN}


KIND = "struct<lang: string, score: double, rejected: boolean>"


def identify(docs: DataFrame, content: dict[str, bytes], name: str = "language", text: str = "text") -> DataFrame:
    """``docs`` with a struct column: language, score (relative margin, 0 to 1), rejected."""
    box = docs.sparkSession.sparkContext.broadcast(content)
    made: list[Classifier] = []

    def run(batch: pa.RecordBatch) -> pa.Array:
        if not made:
            made.append(Classifier(box.value))
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
        return pa.array([made[0].predict(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], kind)

    return add_column(docs, name, KIND, text, run)
