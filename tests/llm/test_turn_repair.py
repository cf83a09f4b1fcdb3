import hashlib
import random
import re
import zlib

from headrace.llm import turn_repair

FORM = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        found = WORD.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "" if found[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit, repaired) over every sequence of edits not dearer than deleting all rows."""
    fault, best = faults(rows), [(4 * len(rows), "D" * len(rows), [])]

    def go(i, cost, audit, said, inserted):
        if (cost, audit) > best[0][:2] and cost > best[0][0]:
            return
        if i == len(rows) and FORM.fullmatch("".join(r[:1] or " " for r, _ in said)):
            best[0] = min(best[0], (cost, audit, said), key=lambda x: x[:2])
        if inserted < 3:
            for r in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*said, (r, "")], inserted + 1)
        if i < len(rows):
            go(i + 1, cost + 4, audit + "D", said, 0)
            if fault[i] in ("", "truncated"):
                more = 3 if fault[i] else 0
                go(i + 1, cost + more, audit + "K", [*said, rows[i]], 0)
                for r in ("user", "assistant"):
                    go(i + 1, cost + more + 3, audit + "R", [*said, (r, rows[i][1])], 0)

    go(0, 0, "", [], 0)
    return best[0]


def plain(rows):
    """(cost, audit) by whole strings, one row after the other."""
    tops = {"": (0, "")}
    need = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(tops):
        for _ in range(3):
            for at, (cost, audit) in list(tops.items()):
                way = (cost + 3, audit + "I")
                tops[need[at]] = min(tops.get(need[at], way), way)
        return tops

    for (role, _), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for at, (cost, audit) in inserts(dict(tops)).items():
            ways = [(at, cost + 4, audit + "D")]
            if fault in ("", "truncated"):
                cost += 3 if fault else 0
                ways.append((need[at], cost + 3, audit + "R"))
                if role[:1] == need[at] or (at == "" and role[:1] == "s"):
                    ways.append((role[:1], cost, audit + "K"))
            for to, c, a in ways:
                new[to] = min(new.get(to, (c, a)), (c, a))
        tops = new
    tops = inserts(tops)
    return min(tops[x] for x in ("", "a") if x in tops)


def order(rows):
    return sorted(((c, n, r if r is not None else " ", t if t is not None else " ") for c, n, r, t in rows), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))


def summary(rows, find):
    """Expected fields of one conversation of (c, turn, role, text) rows."""
    rows = order(rows)
    said = [(r, t) for _, _, r, t in rows]
    found = find(said)
    turns = {n for _, n, _, _ in rows if n is not None}
    fault = faults(said)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(fault.count(x) for x in ("blank", "duplicate", "truncated")), illegal, *found[:2]), found


def run(spark, rows, parts=4, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as piece", "2 as kind", "3 as c").repartition(parts)
    return turn_repair.summaries(turn_repair.repair(df, **more)).collect()


def random_rows(rng, conv, n):
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    text = lambda: rng.choice(["Yes.", "No!", "", " \t", "cut", "ok?", "x. ", None, "long " * 3 + "."])
    return [(conv, rng.choice([None, *range(n)]), role(), text()) for _ in range(n)]


def test_short_conversations_equal_every_sequence_of_edits(spark):
    rng = random.Random(5)
    convs = {c: random_rows(rng, c, rng.randint(1, 4)) for c in range(150)}
    convs[None] = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes.")]
    got = {r.c: r for r in run(spark, [x for v in convs.values() for x in v])}
    assert set(got) == set(convs)
    for c, rows in convs.items():
        want, (_, _, said) = summary(rows, exhaustive)
        assert tuple(got[c])[1:8] == want, rows
        assert got[c].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        assert plain([(r, t) for _, _, r, t in order(rows)]) == want[5:7]


def test_long_conversation_in_pieces(spark):
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "tool"]
    long = [(1, i // 2, rng.choice(roles), f"{i} {rng.choice(['a.', 'b', '', 'c!'])}" if i % 9 else "same.") for i in range(3000)]
    long += [(1, 40, "user", "again and again.")] * 2000
    rest = [x for c in range(2, 60) for x in random_rows(rng, c, 5)]
    once = {r.c: tuple(r) for r in run(spark, long + rest, 1)}
    for rows in (2, 7, 500):
        assert {r.c: tuple(r) for r in run(spark, long + rest, 4, piece_rows=rows)} == once
    assert once[1][1:8] == summary(long, plain)[0]
    pieces = turn_repair.repair(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"), piece_rows=100)
    sizes = [len(r.turns) for r in pieces.collect()]
    assert len(sizes) > 25 and max(sizes) <= 300
    turns = [t for r in pieces.orderBy("piece").collect() for t in r.turns]
    assert FORM.fullmatch("".join(t.role[0] for t in turns))


def test_copies_are_counted_not_repeated(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 5), (1, 1, "user", "", 3), (1, 2, "assistant", "Yes.", 1)], "conv_id long, turn long, role string, text string, n long")
    one = turn_repair.summaries(turn_repair.repair(df, copies="n")).first()
    rows = [(1, 0, "user", "Hi.")] * 5 + [(1, 1, "user", "")] * 3 + [(1, 2, "assistant", "Yes.")]
    assert tuple(one)[1:8] == summary(rows, plain)[0]


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Say {c}. {t}!") for c in range(60) for t in range(4)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{c}:{t if t is not None else ' '}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        want += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = [(r.conv_id, r.turn, r.role, r.text) for r in turn_repair.damage(df).collect() for _ in range(r.copies)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    done = {r.conv_id: r for r in turn_repair.damaged_and_repaired(df).collect()}
    assert set(done) == {c for c, *_ in rows}
    for c, r in done.items():
        own = [x for x in want if x[0] == c]
        if own:
            assert tuple(r)[1:8] == summary(own, plain)[0]
        else:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.damaged_and_repaired(none).count() == 0
