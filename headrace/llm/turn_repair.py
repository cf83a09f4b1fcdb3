"""Conversation structure repair: generalised LR parsing with weighted edits.

The roles of a conversation shall read ``(s?(ua)+)?``: an optional system turn,
then user and assistant in turn. Rows are parsed by the LR table of that grammar;
where a row does not fit it is kept, reroled, deleted, or turns are inserted
before it, each at a price. The stacks of all these choices form a graph. Two
stacks with the same top have the same future, so of them only the one with the
smallest (cost, audit) stays; audits are strings of edits' initials, and as every
stack has read the same rows, none is the beginning of another and their order
never changes later. What a row does to the stack tops depends on its kind only,
hence steps from one set of tops to the next are worked out once and remembered.

Rows are ordered by ranges of (conversation, turn, role, text). A conversation
inside one range is parsed there in one pass. Others, of any length, are cut into
pieces of bounded rows and bytes: a piece is parsed from each of the four tops
it may start with, the pieces' small tables are chained in order, and each piece is
then rebuilt between the tops the chain chose. Equal rows are merged and counted
before they are ordered, as all but the first have to go.

Defined cases: a null role or text is one space; null turns come first; rows of
one turn are ordered by role, then text; a null conversation id is a conversation;
an empty table gives no rows; other columns are not looked at. An audit is one
string and so ends at 2 GB.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .text import bounded

#: Prices: a new role, a deletion, an insertion, a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes of text in a piece of a long conversation; a longer row is a piece alone.
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20
SPACE = " \t\n\x0b\x0c\r"

# Stack tops: nothing read, a system turn, a user turn without answer, complete pairs (u a is reduced to a pair at once).
START, SYSTEM, USER, PAIRS = range(4)
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (PAIRS, "u"): USER, (USER, "a"): PAIRS}
NEXT = {START: "u", SYSTEM: "u", USER: "a", PAIRS: "u"}
ROLE = {"u": "user", "a": "assistant"}
#: What the end of the input inserts at each top.
END = {START: "", SYSTEM: "II", USER: "I", PAIRS: ""}
#: Kinds of rows: initial (other, s, u, a), 4 more if truncated; blank and repeated rows are FORCED out.
INITIALS, CUT, FORCED = " sua", 4, 8


@lru_cache(None)
def edits(kind: int) -> tuple[dict[int, tuple[int, str]], ...]:
    """For each top before a row of this kind: tops after it with the cheapest (cost, letters)."""
    out = []
    for top in range(4):
        best: dict[int, tuple[int, str]] = {}
        now, letters = top, ""
        for _ in range(4):
            paid = INSERT * len(letters)
            ways = [(now, paid + DELETE, letters + "D")]
            if kind != FORCED:
                paid += TRUNCATED if kind & CUT else 0
                ways.append((SHIFT[now, NEXT[now]], paid + REROLE, letters + "R"))
                kept = SHIFT.get((now, INITIALS[kind & 3]))
                if kept is not None:
                    ways.append((kept, paid, letters + "K"))
            for to, cost, text in ways:
                best[to] = min(best.get(to, (cost, text)), (cost, text))
            now, letters = SHIFT[now, NEXT[now]], letters + "I"
        out.append(best)
    return tuple(out)


@lru_cache(1 << 16)
def step(tops: tuple, kind: int) -> tuple[tuple, int, dict[int, tuple[int, str]]]:
    """(tops after the row, cost taken out of them, link of each top: the one below and its letters).

    ``tops`` holds (top, cost above the cheapest, place of its audit among all).
    """
    best: dict[int, tuple] = {}
    for top, cost, place in tops:
        for to, (more, letters) in edits(kind)[top].items():
            way = (cost + more, place, letters, top)
            if to not in best or way < best[to]:
                best[to] = way
    low = min(w[0] for w in best.values())
    order = {to: i for i, to in enumerate(sorted(best, key=lambda x: best[x][1:3]))}
    return tuple((to, best[to][0] - low, order[to]) for to in sorted(best)), low, {to: (w[3], w[2]) for to, w in best.items()}


def parse(kinds: list[int], copies: list[int], start: int) -> tuple[tuple, int, list]:
    """Tops after all rows, the cost of the cheapest, and the links of every row."""
    tops, total, links = ((start, 0, 0),), 0, []
    for kind, n in zip(kinds, copies, strict=True):
        tops, low, link = step(tops, kind)
        links.append(link)
        total += low
        if n > 1:
            # Copies go; whatever is inserted among them comes last, as D is before I.
            tops, low, link = step(tops, FORCED)
            links.append((n - 2, link))
            total += low + DELETE * (n - 2)
    return tops, total, links


def rebuild(rows: list[tuple[str, str]], copies: list[int], links: list, start: int, end: int) -> tuple[str, list[dict]]:
    """Audit and repaired turns between two tops."""
    letters, at = [], end
    for link in reversed(links):
        run, link = link if isinstance(link, tuple) else (0, link)
        at, text = link[at]
        letters.append("D" * run + text)
    letters.reverse()
    top, turns, k = start, [], 0

    def say(initial, role, text):
        nonlocal top
        top = SHIFT[top, initial]
        turns.append({"role": role, "text": text})

    for (role, text), n in zip(rows, copies, strict=True):
        for letter in letters[k]:
            if letter == "K":
                say(role[0], role, text)
            elif letter != "D":
                say(NEXT[top], ROLE[NEXT[top]], text if letter == "R" else "")
        k += 1
        if n > 1:
            for _ in range(letters[k].count("I")):
                say(NEXT[top], ROLE[NEXT[top]], "")
            k += 1
    return "".join(letters), turns


def close(tops: tuple) -> tuple[int, int, str]:
    """(cost above the cheapest, top, letters) of the cheapest end."""
    cost, _, top = min((cost + INSERT * len(END[top]), place, top) for top, cost, place in tops)
    return cost, top, END[top]


def ending(top: int, letters: str) -> list[dict]:
    out = []
    for _ in letters:
        out.append({"role": ROLE[NEXT[top]], "text": ""})
        top = SHIFT[top, NEXT[top]]
    return out


_TURNS = "array<struct<role: string, text: string>>"
_STATS = "struct<blank: long, duplicate: long, truncated: long, illegal: long, turns: long, first_turn: long, last_turn: long, first: string, last: string>"


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))


def faults(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """Distinct rows: c, n, r, t, copies, kind, fault (1 blank, 2 duplicate, 3 truncated, 0 none)."""
    base = rows.select(F.col(conv_id).alias("c"), F.col(turn).cast("long").alias("n"), F.coalesce(F.col(role), F.lit(" ")).alias("r"), F.coalesce(F.col(text), F.lit(" ")).alias("t"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
    same = base.groupBy("c", "n", "r", "t").agg(F.sum("copies").alias("copies")).withColumn("f", F.sha2(F.concat(F.length("r").cast("string"), F.lit(":"), "r", "t"), 256))
    # The first row of each role and text is found by a map-side minimum and joined back on its own turn.
    first = same.groupBy("c", "f").agg(F.min(F.struct(F.col("n").isNotNull().alias("known"), "n")).alias("m")).select(F.col("c").alias("c1"), F.col("f").alias("f1"), F.col("m.n").alias("n1"))
    both = same.join(first, same["f"].eqNullSafe(first["f1"]) & same["c"].eqNullSafe(first["c1"]) & same["n"].eqNullSafe(first["n1"]), "left")
    body = F.rtrim("t", F.lit(SPACE))
    fault = F.when(body == "", 1).when(F.col("f1").isNull(), 2).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.left("r", F.lit(1))
    kind = F.when(F.col("fault").isin(1, 2), FORCED).otherwise(F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + F.when(F.col("fault") == 3, CUT).otherwise(0))
    return both.withColumn("fault", fault).withColumn("kind", kind).select("c", "n", "r", "t", "copies", "kind", "fault")


class _Piece:
    """Rows of one conversation in order, with running statistics."""

    def __init__(self):
        self.rows, self.kinds, self.copies, self.bytes = [], [], [], 0
        self.counts, self.illegal, self.distinct, self.turns, self.ends = [0] * 4, 0, 0, [None, None], [None, None]

    def add(self, n, r, t, copies, kind, fault):
        if self.rows:
            self.illegal += self.ends[1] + r[:1] not in ("su", "ua", "au")
        else:
            self.ends[0] = r[:1]
        self.ends[1] = r[:1]
        self.illegal += copies - 1
        if n is not None:
            self.distinct += n != self.turns[1]
            self.turns = [n if self.turns[0] is None else self.turns[0], n]
        self.counts[fault] += 1
        self.counts[1 if fault == 1 else 2] += copies - 1
        self.rows.append((r, t))
        self.kinds.append(kind)
        self.copies.append(copies)
        self.bytes += len(t) + len(r)

    def full(self, rows: int) -> bool:
        return len(self.rows) >= rows or self.bytes >= PIECE_BYTES

    def out(self, conv, piece: int, whole: bool) -> dict:
        keys = ["blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first", "last"]
        out = {"c": conv, "piece": piece, "whole": whole, "stats": dict(zip(keys, [*self.counts[1:], self.illegal, self.distinct, *self.turns, *self.ends], strict=True))}
        if whole:
            tops, total, links = parse(self.kinds, self.copies, START)
            cost, top, tail = close(tops)
            audit, turns = rebuild(self.rows, self.copies, links, START, top)
            return out | {"cost": total + cost, "audit": audit + tail, "turns": turns + ending(top, tail)}
        table = []
        for start in range(4):
            tops, total, _ = parse(self.kinds, self.copies, start)
            own = {top: (total + cost, place) for top, cost, place in tops}
            table += [x for top in range(4) for x in own.get(top, (-1, -1))]
        return out | {"turns": [{"role": r, "text": t} for r, t in self.rows], "kinds": self.kinds, "copies": self.copies, "table": table}


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, **names) -> DataFrame:
    """Repaired conversations in pieces: c, piece (ascending), whole (the only one), stats, cost, audit, turns.

    ``turns`` are the repaired (role, text); costs add up and audits and turns
    follow one another over the pieces of a conversation.
    """
    bounded(rows)
    marked = faults(rows, **names)
    key = dict(marked.dtypes)["c"]
    ordered = marked.repartitionByRange("c", "n", "r", F.left("t", F.lit(256))).sortWithinPartitions("c", "n", "r", "t")
    schema = T._parse_datatype_string(f"c {key}, piece long, whole boolean, stats {_STATS}, cost long, audit string, turns {_TURNS}, kinds array<int>, copies array<long>, table array<long>")

    def scan(batches):
        base = TaskContext.get().partitionId() << 32
        conv, own, cuts, first, made, out, held = None, None, 0, True, 0, [], 0

        def finish(whole):
            nonlocal made
            made += 1
            return own.out(conv, base + made, whole)

        for batch in batches:
            for c, n, r, t, copies, kind, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if own is None or c != conv or own.full(piece_rows):
                    if own is not None:
                        held += own.bytes
                        # Only the first and the last conversation of a range may go on in another one.
                        out.append(finish(c != conv and not first and cuts == 0))
                        if held >= PIECE_BYTES or len(out) >= 2000:
                            yield _batch(out, schema)
                            out, held = [], 0
                        first, cuts = (first, cuts + 1) if c == conv else (False, 0)
                    conv, own = c, _Piece()
                own.add(n, r, t, copies, kind, fault)
        if own is not None:
            out.append(finish(False))
            yield _batch(out, schema)

    pieces = cut_lineage(ordered.mapInArrow(scan, schema))
    opened = pieces.filter("not whole")
    path = T._parse_datatype_string("piece long, start int, end int, tail string")

    def chain(batches):
        conv, ids, back, tops, seen = None, [], [], None, False

        def finish():
            _, top, tail = close(tops)
            out, to = [], top
            for piece, link in zip(reversed(ids), reversed(back), strict=True):
                out.append({"piece": piece, "start": int(link[to]), "end": to, "tail": "" if out else tail})
                to = int(link[to])
            return _batch(out, path)

        for batch in batches:
            for c, piece, table in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not seen or c != conv:
                    if seen:
                        yield finish()
                    conv, ids, back, tops, seen = c, [], [], ((START, 0, 0),), True
                table = np.array(table).reshape(4, 4, 2)
                best: dict[int, tuple] = {}
                for top, cost, place in tops:
                    for to in range(4):
                        more, order = table[top, to].tolist()
                        if order >= 0 and (to not in best or (cost + more, place, order, top) < best[to]):
                            best[to] = (cost + more, place, order, top)
                link = np.full(4, -1, np.int8)
                for to, way in best.items():
                    link[to] = way[3]
                places = {to: i for i, to in enumerate(sorted(best, key=lambda x: best[x][1:3]))}
                tops = tuple((to, w[0], places[to]) for to, w in best.items())
                ids.append(piece)
                back.append(link)
        if seen:
            yield finish()

    paths = cut_lineage(opened.select("c", "piece", "table").repartition("c").sortWithinPartitions("c", "piece").mapInArrow(chain, path))
    done = T.StructType(schema.fields[:7])

    def rebuilt(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                rows, copies = [(r["role"], r["text"]) for r in x["turns"]], x["copies"]
                tops, total, links = parse(x["kinds"], copies, x["start"])
                cost = total + next(c for top, c, _ in tops if top == x["end"])
                audit, turns = rebuild(rows, copies, links, x["start"], x["end"])
                out = {k: x[k] for k in ("c", "piece", "whole", "stats")}
                yield _batch([out | {"cost": cost + INSERT * len(x["tail"]), "audit": audit + x["tail"], "turns": turns + ending(x["end"], x["tail"])}], done)

    mended = opened.drop("table").join(paths, "piece").mapInArrow(rebuilt, done)
    return pieces.filter("whole").select(done.names).unionByName(mended)


def summaries(pieces: DataFrame) -> DataFrame:
    """One row per conversation: c, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Pieces of a long conversation stream through one task in order; no more than
    a piece and the audit are held.
    """
    schema = T._parse_datatype_string(f"c {dict(pieces.dtypes)['c']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def run(batches):
        now, out, seen = None, [], False

        def begin(c):
            return {"c": c, "sum": [0] * 6, "turns": [None, None], "last": None, "audit": [], "hash": hashlib.sha256(), "said": False}

        def finish():
            first, last = now["turns"]
            blank, duplicate, truncated, illegal, cost, distinct = now["sum"]
            gaps = 0 if first is None else last - first + 1 - distinct
            return {"c": now["c"], "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": cost, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}

        for batch in batches:
            for c, stats, cost, audit, turns in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not seen or c != now["c"]:
                    if seen:
                        out.append(finish())
                        if len(out) >= 4096:
                            yield _batch(out, schema)
                            out = []
                    now, seen = begin(c), True
                add = [stats["blank"], stats["duplicate"], stats["truncated"], stats["illegal"], cost, stats["turns"]]
                if now["last"] is not None:
                    add[3] += now["last"] + stats["first"] not in ("su", "ua", "au")
                if stats["first_turn"] is not None:
                    add[5] -= stats["first_turn"] == now["turns"][1]
                    now["turns"] = [stats["first_turn"] if now["turns"][0] is None else now["turns"][0], stats["last_turn"]]
                now["sum"] = [a + b for a, b in zip(now["sum"], add, strict=True)]
                now["last"] = stats["last"]
                now["audit"].append(audit)
                for x in turns:
                    now["hash"].update(f"{chr(10) if now['said'] else ''}{x['role']}:{x['text']}".encode())
                    now["said"] = True
        if seen:
            out.append(finish())
            yield _batch(out, schema)

    columns = ["c", "stats", "cost", "audit", "turns"]
    whole = pieces.filter("whole").select(columns).mapInArrow(run, schema)
    long = pieces.filter("not whole").repartition("c").sortWithinPartitions("c", "piece").select(columns).mapInArrow(run, schema)
    return whole.unionByName(long)


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn``, modulo 20, and ``copies``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return rows.filter(hit != 0).select("conv_id", "turn", F.when(hit == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(hit == 3, 2).otherwise(1).alias("copies"))


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """The summary of every conversation of ``rows`` after damage and repair; without rows left, zeros."""
    found = summaries(repair(damage(rows), copies="copies"))
    every = rows.select("conv_id").distinct()
    joined = every.join(found, every["conv_id"].eqNullSafe(found["c"]), "left")
    zero = [F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def sql() -> str:
    """The same in SQL over ``conversations``: rows of a conversation folded over (cost, audit) of the four tops."""
    ways = []
    for kind in range(FORCED + 1):
        tops = []
        for to in range(4):
            own = [f"{{'p': {p + 1}, 'k': {e[to][0]}, 's': '{e[to][1]}'}}" for p, e in enumerate(edits(kind)) if to in e]
            tops.append(f"[{', '.join(own)}]")
        ways.append(f"[{', '.join(tops)}]")
    far, none = 1 << 40, "[''::VARCHAR, '', '', '']"
    role = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    after = {t: SHIFT[t, NEXT[t]] for t in range(4)}
    insert = " ".join(f"WHEN {t} THEN '{role[t]}:'" for t in role)
    moved = " ".join(f"WHEN {t} THEN {after[t]}" for t in role)
    ends = " UNION ALL ".join(f"SELECT {t + 1} AS q, {INSERT * len(END[t])} AS k, '{END[t]}' AS s" for t in range(4))
    return f"""
WITH RECURSIVE h AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c FROM range(256) AS r(i)),
crc0 AS (SELECT i, list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM bits),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc0),
keys AS (SELECT DISTINCT key FROM h),
hashed AS (
  SELECT key, xor(list_reduce(list_transform([-1] || list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))), lambda x: CASE WHEN x < 0 THEN 4294967295 ELSE x END),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 20 AS k FROM keys, tab),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h JOIN hashed USING (key) WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM d),
g AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY p) AS before,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM o),
f AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN again THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM g),
c AS (
  SELECT *, CASE WHEN fault IN (1, 2) THEN {FORCED} ELSE CASE role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END + CASE WHEN fault = 3 THEN {CUT} ELSE 0 END END AS kind FROM f),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'c': kind, 'k': [{far}, {far}, {far}, {far}]::BIGINT[], 'a': {none}}} ORDER BY p) AS rows, list(role ORDER BY p) AS roles, list(text ORDER BY p) AS texts
  FROM c GROUP BY conv_id),
ways AS (SELECT [{', '.join(ways)}] AS w),
folded AS (
  SELECT stats.* EXCLUDE (rows), list_reduce([{{'c': -1, 'k': [0, {far}, {far}, {far}]::BIGINT[], 'a': {none}}}] || rows, lambda x, y: {{
    'c': -1,
    'k': list_transform([1, 2, 3, 4], lambda q: list_min(list_transform(w[y.c + 1][q], lambda e: {{'k': x.k[e.p] + e.k, 'a': x.a[e.p] || e.s}})).k),
    'a': list_transform([1, 2, 3, 4], lambda q: coalesce(list_min(list_transform(w[y.c + 1][q], lambda e: {{'k': x.k[e.p] + e.k, 'a': x.a[e.p] || e.s}})).a, ''))}}) AS z
  FROM stats, ways),
ends AS ({ends}),
best AS (
  SELECT conv_id, min({{'k': z.k[q] + k, 'a': z.a[q] || s}}) AS b FROM folded, ends GROUP BY conv_id),
plan AS (SELECT folded.* EXCLUDE (z), b.k AS cost, b.a AS audit FROM folded JOIN best ON folded.conv_id IS NOT DISTINCT FROM best.conv_id),
walk AS (
  SELECT conv_id, audit, roles, texts, 0 AS i, 0 AS r, 0 AS top, []::VARCHAR[] AS said FROM plan
  UNION ALL
  SELECT conv_id, audit, roles, texts, i + 1, r + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
    CASE WHEN e = 'D' THEN top WHEN e = 'K' AND roles[r + 1][1] = 's' THEN {SYSTEM} ELSE CASE top {moved} END END,
    CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, roles[r + 1] || ':' || texts[r + 1])
      ELSE list_append(said, CASE top {insert} END || CASE WHEN e = 'R' THEN texts[r + 1] ELSE '' END) END
  FROM (SELECT *, audit[i + 1] AS e FROM walk WHERE i < length(audit))),
last AS (SELECT conv_id, sha256(array_to_string(said, chr(10))) AS repaired_sha256 FROM walk WHERE i = length(audit))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN plan ON o.conv_id IS NOT DISTINCT FROM plan.conv_id LEFT JOIN last ON o.conv_id IS NOT DISTINCT FROM last.conv_id
"""
