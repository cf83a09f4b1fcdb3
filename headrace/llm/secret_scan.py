"""Secret scans by assignment-aware lexing.

Three base patterns (an assignment to a telling name, an access key, a long hex
run) always count. The method adds what they miss: every separator (``=``,
``:``, ``:=``, ``=>``, ``+=``) of a text is read as an assignment, its target to the left
(a name, a path, a quoted key, an index) and its value to the right (string
literals of usual languages, bare words, names, joined by operators, inside known
wrapper calls, or interpolated). Names stand for what was last assigned to them,
so a value is a node of a graph whose leaves are literals, and a node's measures
(length, kinds of characters) are sums over its parts: constants are propagated
without building their strings. A node assigned to a target whose name is telling
enough for the literal's own score makes all literals below it secrets, also those
that were given to a harmless name first. Each node is visited once, so the work
is linear in the text.

A text is one row, read whole by the task it lies in; nothing is shuffled.

Defined cases: a null text is empty and has no spans; rows are independent, so
ties and repeated rows are scanned each; an empty table gives no rows; other
columns are kept, one with the name of the result is replaced. Spans are in code
points, the end exclusive; a literal inside a base span is not repeated.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import add_column

# The base patterns, least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6
KINDS = ["assign", "access", "hex", "literal"]

#: Least product of the name's and the literal's score.
THRESHOLD = 0.5
#: Weights of words in names, and words that lift a ``key`` beside them.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "passcode": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "authorization": 0.7, "auth": 0.6, "salt": 0.6, "pin": 0.5, "signature": 0.5, "key": 0.4,
}
KEYS = {"api", "access", "private", "secret", "encryption", "signing", "account", "master", "shared", "client", "service", "storage", "ssh", "aes", "hmac", "app", "deploy"}
#: A name that ends in one of these is about a secret but holds none.
ABOUT = {
    "count", "length", "len", "limit", "size", "type", "name", "field", "label", "url", "uri", "path", "file", "dir", "endpoint", "hint", "policy", "regex", "pattern", "expires",
    "expiry", "ttl", "timeout", "id", "header", "format", "prefix", "provider", "placeholder", "required", "enabled", "form", "input", "prompt", "title", "message", "error",
}
#: Literals that stand in for a value.
STAND_INS = re.compile(r"(?:change_?me|placeholder|example|sample|dummy|redacted|undefined|optional|required|insert|your[_ -].*|my[_ -]?(?:password|secret|token)|password|passwd|secret|default|string|<.*>|\.\.\.|\*+|x+)\d?", re.IGNORECASE | re.DOTALL)
#: Calls that hand their argument on.
WRAPPERS = {"str", "bytes", "string", "encode", "decode", "b64decode", "b64encode", "atob", "btoa", "quote", "trim", "strip", "secretstr", "of", "valueof", "buffer.from", "from"}

_SEPARATOR = re.compile(r"[:=]")
_QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*{q}", re.DOTALL) for q in "\"'"} | {"`": re.compile(r"(?:[^`\\]|\\.)*`", re.DOTALL)}
_OPEN = re.compile(r"(?:[rRbBuUfFlL]{1,2}|@|\$)?(\"\"\"|'''|[\"'`])")
_BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>]+")
_NAME = re.compile(r"[^\W\d][\w$.]*")
_JOIN = re.compile(r"[ \t]*(?:\+(?!=)|&(?!&)|\|\||\?\?|\.\.|\bor\b|\.(?=[ \t]*[\"'$]))\s*")
_METHOD = re.compile(r"\.\w+\(\)")
_INSERT = re.compile(r"\$\{\s*([\w.]+)\s*\}|\$\(\s*([\w.]+)\s*\)|\{\{?\s*([^\W\d][\w.]*)\s*\}\}?|\$([^\W\d]\w*)|%\(([\w.]+)\)s|%([^\W\d]\w*)%")
_TAG = re.compile(r"<([A-Za-z][\w.:-]*)>([^<>\s]+)</\1>")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    best = max(WEIGHTS.get(w, 0.0) for w in words)
    return 1.0 if any(a in KEYS and b == "key" for a, b in zip(words, words[1:])) else best


def measure(literal: str) -> tuple:
    """Sums of a literal: length, lower, upper, digits, others, spaces; then most distinct characters, stand-in or path."""
    lower, upper, digit = (sum(map(f, literal)) for f in (str.islower, str.isupper, str.isdigit))
    space = sum(map(str.isspace, literal))
    odd = bool(STAND_INS.fullmatch(literal)) or "://" in literal or literal.count("/") > 2 and not digit
    return (len(literal), lower, upper, digit, len(literal) - lower - upper - digit - space, space, len(set(literal)), odd)


def plus(a: tuple, b: tuple) -> tuple:
    return (*(min(x + y, 1 << 40) for x, y in zip(a[:6], b[:6], strict=True)), max(a[6], b[6]), a[7] and b[7])


def literal_score(m: tuple) -> float:
    length, lower, upper, digit, other, space, distinct, odd = m
    if odd or length < MIN_VALUE or distinct < 4:
        return 0.0
    kinds = sum(x > 0 for x in (lower, upper, digit, other))
    score = (0.5 if length < 8 else 0.7 if length < 16 else 0.9) + (0.1 * (kinds - 1) if kinds > 1 else 0.1 if digit else -0.25)
    return min(score, 1.0) * (1.0 if not space else 0.8 if space == 1 else 0.5)


class Lexer:
    """Assignments of one text as a graph of values."""

    def __init__(self, text: str):
        self.text, self.env = text, {}
        self.spans: list = []  # of a node: (start, end), None above literals
        self.parts: list[list[int]] = []
        self.sums: list[tuple] = []
        self.hot: list[int] = []

    def literal(self, start: int, end: int) -> int:
        self.spans.append((start, end))
        self.parts.append([])
        self.sums.append(measure(self.text[start:end]))
        return len(self.spans) - 1

    def inside(self, start: int, end: int) -> list[int]:
        """Nodes of a string: its literal stretches and the names it inserts."""
        out, at = [], start
        for m in _INSERT.finditer(self.text, start, end):
            node = self.env.get(m[m.lastindex])
            if node is not None:
                out += [self.literal(at, m.start())] * (m.start() > at) + [node]
                at = m.end()
        return out + ([self.literal(at, end)] if end > at else [])

    def word(self, start: int, end: int) -> list[int]:
        """Nodes of a bare word: names that are known, else the word itself."""
        word = self.text[start:end]
        known = [self.env.get(w.lstrip("$")) for w in word.split("+")]
        return known if None not in known else self.inside(start, end)

    def value(self, at: int) -> tuple[list[int], int]:
        """(nodes, end) of the expression that starts at ``at``."""
        text, nodes, depth, quoted, size = self.text, [], 0, False, len(self.text)
        while at < size:
            while at < size and (text[at] in " \t" or depth and text[at].isspace()):
                at += 1
            m = _OPEN.match(text, at)
            if m:
                q = m[1]
                if len(q) == 3:
                    end = text.find(q, m.end())
                    end, after = (end, end + 3) if end >= 0 else (size, size)
                else:
                    s = _QUOTED[q].match(text, m.end())
                    if s is None:  # never closed on its line: a bare word
                        b = _BARE.match(text, m.end())
                        return (nodes + self.inside(b.start(), b.end()), b.end()) if b else (nodes, m.end())
                    end, after = s.end() - 1, s.end()
                nodes += self.inside(m.end(), end)
                at, quoted = after, True
            elif at < size and text[at] == "(" and not nodes:
                at, depth = at + 1, depth + 1
                continue
            else:
                b = _BARE.match(text, at)
                if b is None:
                    return nodes, at
                if text[b.end() : b.end() + 1] == "(":
                    call = b[0].lower()
                    if call not in WRAPPERS and call.rsplit(".", 1)[-1] not in WRAPPERS:
                        return [], b.end()
                    at, depth = b.end() + 1, depth + 1
                    continue
                nodes += self.word(b.start(), b.end())
                at, quoted = b.end(), False
            while True:
                m = _METHOD.match(text, at)
                if m:
                    at = m.end()
                elif depth and text[at : at + 1] == ")":
                    at, depth = at + 1, depth - 1
                else:
                    break
            m = _JOIN.match(text, at)
            if m:
                at = m.end()
                continue
            near = at
            while near < size and (text[near] in " \t" or depth and text[near].isspace()):
                near += 1
            if not (quoted and _OPEN.match(text, near)):
                return nodes, at
            at = near
        return nodes, at

    def target(self, low: int, end: int) -> tuple[str, int]:
        """(name, start) of the name that ends before ``end``."""
        text, tail = self.text, ""
        while end > low and text[end - 1] in " \t":
            end -= 1
        if end > low and text[end - 1] == "]":
            at = text.rfind("[", low, end - 1)
            if at < 0:
                return "", end
            tail, end = text[at + 1 : end - 1].strip("\"' "), at
        elif end > low and text[end - 1] in "\"'`":
            at = text.rfind(text[end - 1], low, end - 1)
            inner = text[at + 1 : end - 1]
            return (inner, at) if at >= 0 and "\n" not in inner else ("", end)
        at = end
        while at > low and (text[at - 1].isalnum() or text[at - 1] in "_$.-"):
            at -= 1
        return ".".join(x for x in (text[at:end].strip("-$."), tail) if x), at

    def bind(self, name: str, nodes: list[int], add: bool) -> None:
        if add and name in self.env:
            nodes = [self.env[name], *nodes]
        if not nodes:
            self.env.pop(name, None)
            return
        node = nodes[0]
        if len(nodes) > 1:
            total = self.sums[node]
            for n in nodes[1:]:
                total = plus(total, self.sums[n])
            self.spans.append(None)
            self.parts.append(nodes)
            self.sums.append(total)
            node = len(self.spans) - 1
        self.env[name] = node
        if name_score(name) * literal_score(self.sums[node]) >= THRESHOLD:
            self.hot.append(node)

    def run(self) -> list[tuple[int, int]]:
        """Spans of the literals that reach a telling name."""
        text, at, low, typed = self.text, 0, 0, (-1, "")
        while True:
            m = _SEPARATOR.search(text, at)
            if m is None:
                break
            p, end = m.start(), m.end()
            two, before = text[p : p + 2], text[p - 1 : p]
            if two in ("==", "=~", "::") or text[p : p + 3] == "://":
                at = low = p + (3 if two == ":/" else 2)
                continue
            if two in (":=", "=>"):
                end += 1
            elif text[p] == "=" and before in ("!", "<", ">"):
                at = low = end
                continue
            add = before == "+" and text[p] == "="
            name, start = self.target(low, p - add)
            if text[p] == "=" and typed[0] == start and typed[1] and start < p:
                name = typed[1]  # name: type = value
            nodes, after = self.value(end) if name else ([], end)
            typed = (-1, "")
            if text[p] == ":" and two == ": " or text[p] == ":" and two[1:].isalpha():
                begin = end
                while begin < after and text[begin] in " \t":
                    begin += 1
                typed = (begin, name) if _NAME.fullmatch(text, begin, after) else typed
            if name:
                self.bind(name, nodes, add)
            low = end
            at = max(after, end)
            if typed[0] < 0:
                low = at
        for m in _TAG.finditer(text) if "</" in text else ():
            self.bind(m[1], self.word(m.start(2), m.end(2)), False)
        seen, out = set(), []
        while self.hot:
            node = self.hot.pop()
            if node not in seen:
                seen.add(node)
                self.hot += self.parts[node]
                if self.spans[node]:
                    out.append(self.spans[node])
        return sorted(set(out))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns, ordered."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    out += [(m.start(), k, m.end()) for k, pattern in ((1, ACCESS), (2, HEX)) for m in pattern.finditer(text)]
    return sorted(out)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each (start, kind, end) in order."""
    base = base_spans(text)
    if ":" not in text and "=" not in text and "</" not in text:
        return base, base
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    more = []
    for s, e in Lexer(text).run():
        i = bisect_right(starts, s)
        if not i or ends[i - 1] < e:
            more.append((s, 3, e))
    return base, sorted(base + more)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with every stretch covered by spans replaced."""
    out, at = [], 0
    for s, _, e in spans:
        if e > at:
            if s >= at:
                out += [text[at:s], mark]
            at = e
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, name: str = "secrets", text: str = "text") -> DataFrame:
    """``docs`` with ``name``: base and all, arrays of (start, end, kind)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.Array:
        out = []
        for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
            rows = [[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in spans] for spans in find(value or "")]
            out.append({"base": rows[0], "spans": rows[1]})
        return pa.array(out, pa.struct([("base", kind), ("spans", kind)]))

    row = "array<struct<start: long, end: long, kind: string>>"
    return add_column(docs, name, f"struct<base: {row}, spans: {row}>", text, run)


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, n_literal, base_sha256, spans."""
    found = scan_secrets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "found").select("doc_id", "found.*")
    count = lambda a, k: F.size(F.filter(a, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count("base", k) for k in KINDS[:3]] + [count("spans", KINDS[3])]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
