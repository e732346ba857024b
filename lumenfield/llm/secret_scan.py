"""Secrets by assignment-aware lexing.

Texts are read as source or configuration: each run of ":" and "=" is an operator, with the name of
its target on the left (an identifier, a quoted key, an index in brackets; of "name: type = value"
the name too) and an expression on the right (strings with prefixes and escapes, joined by "+", "."
or nothing, names, calls, bare values). An element <name>value</name> and the user part of a url are
pairs as well. Literals are the leaves of a graph: a name stands for what it was given last, a
concatenation for its terms. What reaches a target with a sensitive name, directly or by constants,
carries that name's score down to its literals, each edge once, so propagation is linear however
often constants are joined. A literal counts if the name's score and its own (length, characters,
entropy; nothing for placeholders) reach LEAST together.

The base kinds come out of the same walk: assign is an operator whose target ends in one of five
words, access and hex are literals told by their own form. Per kind, matches are leftmost and don't
overlap; one that fails its check is passed over whole. A literal inside an assign span isn't told
again.

Null texts count as empty and give no spans. Repeated rows each give their own row. An empty table
gives an empty result. Work and memory per text are in proportion to its length: what lies between
two operators is looked at by these two only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_columns

#: Base kinds in the order of the contract, then the kind that the method adds.
KINDS = ("assign", "access", "hex", "literal")
BASE = 3
#: A literal is a secret from this sum of scores on.
LEAST = 4
#: Words of names and what they score; pairs of words that score together; words after which a name isn't the secret itself.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "passcode": 3, "secret": 3, "secrets": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "bearer": 3,
    "authorization": 3, "auth": 2, "pin": 2, "otp": 2, "pass": 2, "key": 1, "signature": 1, "session": 1, "cookie": 1, "salt": 1,
}
TOGETHER = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("account", "key"), ("auth", "key"), ("master", "key"), ("connection", "string")}
DULL = {
    "hash", "length", "len", "size", "min", "max", "count", "type", "name", "id", "url", "uri", "path", "file", "label", "field", "prompt", "hint", "policy", "expiry", "expires", "ttl",
    "error", "message", "regex", "pattern", "format", "column", "title", "class", "endpoint", "header", "provider", "required", "enabled",
}
PLACEHOLDER = re.compile(
    r"x{3,}|\*+|\.+|-+|_+|none|null|nil|true|false|undefined|empty|required|optional|string|change.{0,2}me.*|your.*|my[_-].*|todo.*|fixme.*|dummy.*|sample.*|example.*|placeholder.*|insert.*|redacted.*"
    r"|<.*>|\$\{.*\}?|\{\{.*|\{.*\}|%\(.*|%[a-z_]+%?|\$[a-z_][a-z0-9_]*|\$\(.*|(?:os|process|env|sys|system|config|settings|self|this|request|req|args|options|params)\..*", re.I | re.A | re.S
)
SCHEMES = {"bearer", "basic", "token", "digest"}
GETTERS = re.compile(r"(?:^|[._])(?:get_?env|env|environ|get|fetch|getProperty|lookup)$", re.A)

OPERATOR = re.compile(r"[:=]+")
KEYWORD = re.compile(r"(?:password|passwd|secret|token|api_?key)\Z", re.I | re.A)
VALUE_AT = re.compile(r"[A-Za-z0-9+/_.=-]+").match
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)>([^<>\n]++)</")
USER_AT = re.compile(r"//[^\s/@:\"'<>]*+:([^\s/@\"'<>]++)@").match
#: Possessive, so a string that isn't closed fails at once.
STRING_AT = re.compile(r"[rbfuRBFU@$]{0,2}(?:\"\"\"((?:[^\"\\]|\\.|\"(?!\"\"))*+)\"\"\"|'''((?:[^'\\]|\\.|'(?!''))*+)'''|\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)", re.S).match
NAME_AT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*+").match
BARE_AT = re.compile(r"(?:[^\s\"'`,;<>{}()\[\]&|=\\:]|:(?![\s\"'`]|\Z))++(?:={1,2}(?=[\s\"'`,;<>)\]}&|]|\Z))?").match
ENDS_NAME = frozenset(" \t\r\n+,;)]}.")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.$-")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
QUOTES = frozenset("\"'`")


@lru_cache(1 << 14)
def name_score(name: str) -> int:
    """How sensitive a target is by its name: 0 to 3."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words:
        return 0
    best = max(SENSITIVE.get(w, 0) for w in (*words, "".join(words)))
    if any(p in TOGETHER for p in zip(words, words[1:])):
        best = 3
    return max(0, best - 2) if words[-1] in DULL or "public" in words else best


def literal_score(value: str, bare: bool, length: int) -> int:
    """How much a literal looks like a secret; `length` is that of the whole value that it is part of."""
    if length < 6 or PLACEHOLDER.fullmatch(value):
        return -9
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    score = (length >= 8) + (length >= 16) + (letters and digits) + any(not c.isalnum() and not c.isspace() for c in value)
    if len(value) >= 20:
        n = len(value)
        score += -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= 3.5
    if bare and not digits:
        score -= 2
    return score - min(3, len(value.split()) - 1)


class Values:
    """The graph of values: literals (start, end, bare) and concatenations (their terms)."""

    def __init__(self) -> None:
        self.nodes: list[tuple] = []
        self.length: list[int] = []

    def literal(self, start: int, end: int, bare: bool) -> int:
        self.nodes.append((start, end, bare))
        self.length.append(end - start)
        return len(self.nodes) - 1

    def joined(self, terms: list[int]) -> int:
        if len(terms) == 1:
            return terms[0]
        self.nodes.append((terms,))
        self.length.append(min(1 << 40, sum(self.length[t] for t in terms)))
        return len(self.nodes) - 1

    def reached(self, marks: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """Literal -> (score, length of the whole value) of the best of the marked (node, score) that it is part of."""
        best: dict[int, tuple[int, int]] = {}
        stack = [(node, score, self.length[node]) for node, score in marks]
        while stack:
            node, score, length = stack.pop()
            if best.get(node, (0, 0))[0] >= score:
                continue
            best[node] = (score, length)
            if len(self.nodes[node]) == 1:
                stack += [(t, score, length) for t in self.nodes[node][0]]
        return {n: b for n, b in best.items() if len(self.nodes[n]) == 3}


def target(text: str, low: int, at: int) -> str:
    """The name that an operator at `at` gives a value to, looked for from `low` on; empty if there is none."""
    while at > low and text[at - 1] in " \t":
        at -= 1
    if at > low and text[at - 1] in "!+?":
        at -= 1
        while at > low and text[at - 1] in " \t":
            at -= 1
    if at > low and text[at - 1] == "]":
        at -= 1
    start = at
    if at > low and text[at - 1] in QUOTES:
        quote, at = text[at - 1], at - 1
        start = at
        while start > low and text[start - 1] != quote and text[start - 1] != "\n":
            start -= 1
        return text[start:at] if start > low and text[start - 1] == quote else ""
    while start > low and text[start - 1] in NAME:
        start -= 1
    return text[start:at]


def expression(text: str, at: int, values: Values, constants: dict[str, int]) -> tuple[int | None, int]:
    """The value that starts at `at`, as a node or None, and its end."""
    terms: list[int] = []
    while True:
        while at < len(text) and text[at] in " \t":
            at += 1
        if m := STRING_AT(text, at):
            terms.append(values.literal(*m.span(m.lastindex), False))
            at = m.end()
        elif (m := NAME_AT(text, at)) and text[m.end() : m.end() + 1] == "(":
            inner = m.end() + 1
            if not (s := STRING_AT(text, inner)):
                break
            if GETTERS.search(m[0]):  # the first argument is a name, the second what stands in for it
                rest = s.end()
                s = STRING_AT(text, rest + 2) if text[rest : rest + 2] == ", " else STRING_AT(text, rest + 1) if text[rest : rest + 1] == "," else None
                if not s:
                    break
            terms.append(values.literal(*s.span(s.lastindex), False))
            at = s.end()
            while at < len(text) and text[at] in " \t)":
                at += 1
        elif m and (node := constants.get(plain_name(m[0]))) is not None and text[m.end() : m.end() + 1] in ENDS_NAME | {""}:
            terms.append(node)
            at = m.end()
        elif not terms and (m := BARE_AT(text, at)):
            if m[0].lower() in SCHEMES and (more := BARE_AT(text, m.end() + 1)) and text[m.end()] == " ":
                m = more
            start, end = m.span()
            while end > start and text[end - 1] in ".,;:!?":
                end -= 1
            return (values.literal(start, end, True) if end > start else None), m.end()
        else:
            break
        while at < len(text) and text[at] in " \t":
            at += 1
        if text[at : at + 1] in ("+", ".") and at < len(text):
            at += 1
        elif not STRING_AT(text, at):
            break
    return (values.joined(terms) if terms else None), at


def plain_name(name: str) -> str:
    """A name without what stands for the object itself."""
    return name.removeprefix("self.").removeprefix("this.").lstrip("$-")


def find_secrets(text: str | None) -> list[tuple[int, int, int, str, int]]:
    """(start, kind number, end, name, score) of all spans, in order; offsets in code points, end exclusive. Base kinds have no name and score 0."""
    if not text:
        return []
    out: list[tuple[int, int, int, str, int]] = []
    values, constants, marks = Values(), {}, []
    named: dict[int, str] = {}

    def give(name: str, score: int, node: int | None) -> None:
        if node is not None and score:
            marks.append((node, score))
            named.setdefault(node, name)

    after = covered = low = 0
    before = ("", "")
    for m in OPERATOR.finditer(text):
        at, end = m.span()
        # the base kind: a word, a quote, spaces, the operator's first character
        left = at
        while left > low and text[left - 1] == " ":
            left -= 1
        if left > low and text[left - 1] in "\"'":
            left -= 1
        if left - 3 > low and (word := KEYWORD.search(text, max(low, left - 8), left)) and word.start() >= after:
            value = at + 1
            while value < len(text) and text[value] == " ":
                value += 1
            if value < len(text) and text[value] in "\"'":
                value += 1
            if got := VALUE_AT(text, value):
                after = got.end()
                if after - value >= 6:
                    out.append((word.start(), 0, after, "", 0))
        # the pair of name and value
        name = target(text, low, at) if at >= covered else ""
        if m[0] == ":" and text.startswith("//", end):
            if user := USER_AT(text, end):
                give("password", 3, values.literal(*user.span(1), False))
        elif name and text[at - 1] not in "<>":
            start = end + text.startswith(">", end)
            node, covered_to = expression(text, start, values, constants)
            # of "name: type = value" the first name counts too
            other = before[1] if before[0] == ":" and m[0] == "=" and "\n" not in text[low:at] else ""
            score, name_ = max((name_score(n), n) for n in (name, other))
            give(name_, score, node)
            if node is not None:
                if "=" in m[0] and len(m[0]) < 3 and m[0] != "==":
                    constants[plain_name(name)] = node
                    if other:
                        constants[plain_name(other)] = node
                bare = len(values.nodes[node]) == 3 and values.nodes[node][2]
                if bare or len(values.nodes[node]) == 1:
                    covered = covered_to
        before, low = (m[0], name), end
    for m in ELEMENT.finditer(text):
        if score := name_score(m[1]):
            give(m[1], score, values.literal(*m.span(2), False))
    out += [(m.start(), 1, m.end(), "", 0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), "", 0) for m in HEX.finditer(text)]
    if marks:
        spans = sorted((s[0], s[2]) for s in out if s[1] == 0)
        found: dict[tuple[int, int], tuple[str, int]] = {}
        for node, (score, length) in values.reached(marks).items():
            start, end, bare = values.nodes[node]
            total = score + literal_score(text[start:end], bare, length)
            if total >= LEAST and end > start:
                name, most = found.get((start, end), ("", 0))
                if total > most:
                    found[start, end] = (named.get(node, name), total)
        i = 0
        for (start, end), (name, total) in sorted(found.items()):
            while i < len(spans) and spans[i][1] < end:
                i += 1
            if i == len(spans) or spans[i][0] > start:
                out.append((start, 3, end, name, total))
    return sorted(out)


def render(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, and spans as an array of structs (kind, start, end, the sensitive name that a literal reaches directly, score)."""

    def make(ids, texts):
        return [ids, [[{"kind": KINDS[k], "start": a, "end": b, "name": n or None, "score": s} for a, k, b, n, s in find_secrets(t)] for t in texts]]

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_columns(d, make, "id long, spans array<struct<kind:string,start:int,end:int,name:string,score:int>>").withColumnRenamed("id", id_col)


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def make(ids, texts):
        found = [find_secrets(t) for t in texts]
        counts = [[sum(s[1] == k for s in spans) for spans in found] for k in range(BASE)]
        sha = [hashlib.sha256(render([s for s in spans if s[1] < BASE]).encode()).hexdigest() for spans in found]
        return [ids, *counts, sha, [render(spans) for spans in found]]

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(d, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
