import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from headrace.llm import queries, tokens

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")


def want(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    start, out = 0, []
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        out.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_query_equals_plain_encoding(spark):
    rows = sorted((r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect())
    got = sorted(tuple(r)[:4] for r in queries.QUERIES["op2_token_ids"](spark, SF).collect())
    assert got == want(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(None, "first"), (1, None), (2, ""), (3, "<|endoftext|> x"), (3, "<|endoftext|> x"), (4, "w " * 90_000), (-5, "é漢😀")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).repartition(3)
    got = tokens.read_token_files(tokens.write_token_files(df, str(tmp_path / "out"), FILE)).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == want([(None, "first"), (-5, "é漢😀"), (1, None), (2, ""), *rows[3:6]])
    empty = tokens.write_token_files(df.limit(0), str(tmp_path / "none"), FILE)
    assert empty.count() == 0 and tokens.read_token_files(empty).count() == 0


def test_odd_texts_equal_the_library():
    from tokenizers import Tokenizer

    code, library = tokens.Encoder(FILE), Tokenizer.from_file(FILE)
    assert np.frombuffer(code.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    parts = ["word", "two.", "it's", "dogs'", "\n", " ", "x\ny", "a.\nB,", "\n\n", "\t", "é", "漢字", "12", "3.", "\x85", "\u2028", "...", '"q"', "'", "'ll", "end?\n", "\nstart", "<|endoftext|>", "<|endof", "ª", "²", "\r\n", ")", "a)"]
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 4, 6, 12) * 400:
        text = rng.choice(["", " "]).join(rng.choice(parts, size))
        assert np.frombuffer(code.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    plain = tokens.Encoder(FILE, special=False)
    assert 50256 not in np.frombuffer(plain.encode("a <|endoftext|> b"), "<u4")


def test_small_caches_change_nothing(monkeypatch):
    want = tokens.Encoder(FILE).batch(texts := [f"w{i % 7} some word{i} ends.\nNext, {i}" for i in range(200)])
    monkeypatch.setattr(tokens, "CACHE", 3)
    assert tokens.Encoder(FILE).batch(texts) == want


def test_reader_opens_only_needed_frames_and_sees_damage(tmp_path):
    docs = [np.arange(n, dtype="<u4").tobytes() for n in (5, 300_000, 1, 70_000, 0)]
    path = tmp_path / "x.zst"
    fs, local = tokens.file_system(str(path))
    with fs.open_output_stream(local, compression=None) as out:
        w = tokens.FrameWriter(out)
        for i, d in enumerate(docs):
            w.add(i * 10, d)
        w.close()
    with fs.open_input_file(local) as f:
        r = tokens.FrameReader(f)
        assert r.document(int(r.find(30)[0])).tobytes() == docs[3]
        assert r.read_frames <= 2 < r.packed.size
        assert [r.document(k).tobytes() for k in range(5)] == docs
    data = path.read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(docs)
    broken = bytearray(data)
    broken[200] ^= 1
    path.write_bytes(broken)
    with fs.open_input_file(local) as f, pytest.raises((ValueError, zstandard.ZstdError)):
        tokens.FrameReader(f).document(0)
