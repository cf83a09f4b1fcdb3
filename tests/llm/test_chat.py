import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headrace.llm import chat, queries

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")


def want(rows):
    out, by = {}, {}
    for c, n, r, t in rows:
        by.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    for c, x in by.items():
        x.sort()
        learn = "".join(t for _, _, r, t in x if r == "assistant")
        out[c] = (len(x), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in x).encode()).hexdigest(), len(learn), hashlib.sha256(learn.encode()).hexdigest())
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    s = "</s>[INST] ok [/INST]"
    got = {r[0]: tuple(r)[1:5] for r in queries.QUERIES["op3_chat"](spark, SF).collect()}
    assert got == want([*rows, (-1, 0, "user", s), (-1, 1, "assistant", s)])


def test_odd_rows_ids_and_mask(spark):
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", "<|end|>"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (1, None, None, None),
        (None, 1, "assistant", "<\\|end|> <|endoftext|>"), (2, 1, "<|says|>", ""), (3, 1, "assistant", "x " * 60_000), (4, 1, "tool", "é漢😀"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("input_ids", F.lit(1))
    chats = chat.format_chats(df, FILE)
    got = {r[0]: tuple(r)[1:5] for r in chat.chat_digests(chats, FILE).collect()}
    assert got == want(rows)
    by = {r.conv_id: r for r in chats.collect()}
    base = chat.template(FILE).base
    assert [i - base for i in by[1].input_ids if i >= base] == [0, *[1, 2, 3] * 5]
    assert by[1].loss_mask.count(1) == 6 and by[2].loss_mask.count(1) == 0  # three one-letter texts, each with its end
    assert by[None].formatted == "<|begin|><|turn|>assistant<|says|><\\\\|end|> <\\|endoftext|><|end|>"
    assert chat.format_chats(df.limit(0), FILE).count() == 0


def test_long_conversations_and_copies_in_bounded_rows(spark):
    rows = [(1, i // 3, ["user", "assistant", "tool"][i % 3], f"turn {i} <|end|> of many") for i in range(3000)]
    rows += [(1, 400, "assistant", "the same again")] * 1500 + [(None, None, "assistant", "x")] * 700
    rows += [(c, t, "assistant" if t % 2 else "user", f"{c} says {t}") for c in range(2, 300) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for piece in (64, 4096):
        chats = chat.format_chats(df, FILE, piece_rows=piece).cache()
        sizes = [r.n_turns for r in chats.select("n_turns").collect()]
        assert sum(sizes) == len(rows) and max(sizes) <= piece
        assert {r[0]: tuple(r)[1:5] for r in chat.chat_digests(chats, FILE).collect()} == want(rows)
        base, ids = chat.template(FILE).base, {}
        for r in chats.orderBy("piece").collect():
            assert len(r.input_ids) == len(r.loss_mask)
            ids.setdefault(r.conv_id, []).extend(r.input_ids)
        assert all(x.count(base) == 1 and x[0] == base for x in ids.values())
    # The largest turn of a small piece limit in bytes.
    assert chats.filter("whole").count() > 250


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "</s>", "[INST]", "\\", "|", "end|>", "<|end|>", "[", "/INST]", "s>", "a", "<s>"]), max_size=12))
def test_escaping_is_reversible_and_hides_control_strings(parts):
    text = "".join(parts)
    assert chat.unescape(chat.escape(text)) == text
    assert not any(x in chat.escape(text) for x in [*chat.RESERVED, *chat.FOREIGN])
