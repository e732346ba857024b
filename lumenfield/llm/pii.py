"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors: at-signs, plus signs, digits, "://" and cue words of
identifiers, in any case. A small parser per kind expands each anchor to the left and right and
checks what it finds. Per kind, matches are leftmost and don't overlap; a match that fails its check
is passed over whole.

The kinds beside the contract's four: a url has a host that is a name with a dot, localhost or an
address. An account follows a cue word: an IBAN passes its check digits, in groups or not; a social
security number has an area, group and serial that are given out; an account or passport number has
four digits or more; a password, secret or token follows ":" or "=" and may be of any length and any
marks (a short one of letters only: not after ":" without quotes), or is 16 characters or more with
letters and digits. "is" or "was", a closing quote or bracket may stand between cue and value.

Null texts count as empty and give no spans. Repeated rows each give their own row. An empty table
gives an empty result. Work and memory per text are in proportion to its length: what one anchor looks at
ends at the next anchor of its kind, or is passed over by those after it.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_columns

#: Base kinds in the order of the contract, then the kinds that the anchors add.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4
#: Words that announce an identifier, by what follows them. "-", "_", " " and nothing may stand for one another.
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security number"),
    "number": ("account", "acct", "passport", "customer id", "tax id"),
    "secret": ("token", "password", "passwd", "passphrase", "secret", "api key", "access key", "private key", "bearer", "credential"),
}

DIGITS = frozenset("0123456789")
LOWER = {c: c + 32 for c in range(65, 91)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
IP_AT = re.compile(r"[0-9]+(?:\.[0-9]+){3}").match
CARD_AT = re.compile(r"[0-9](?:[ -]?[0-9])+").match
PHONE_AT = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
URL_AT = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+").match
#: A url's host, matched in place: it can't hold a slash, so what one "://" looks at ends before the next. Possessive: no second tries.
LABEL = r"[^\s/?#@:.\[\]<>\"'`{}|\\^,;!()*$%&]++"
HOST_AT = re.compile(r"(?:[^\s/?#@<>\"'`{}|\\^\[\]]*+@)?+(?:localhost(?![^\s/?#:,;.!)])|" + LABEL + r"(?:\." + LABEL + r")++)(?!@)").match
#: What may stand between a cue and its value: an ending of the cue, words for "number", closing quotes or brackets, "is" or "was", a sign.
NAMED = r"s?(?:[ \t]{1,4}(?:no|nr|num|number|id|key|value|code)\b\.?)?[\"')\]]{0,2}(?:[ \t]{1,4}(?:is|was)\b)?"
SIGN = r"[ \t]{0,4}[:=#][ \t]{0,4}"
IBAN_AT = re.compile(NAMED + r"(?:" + SIGN + r"|[ \t]{1,4})[\"']?([A-Za-z]{2}[0-9]{2}(?:[ ]?[A-Za-z0-9]){11,30})").match
SSN_AT = re.compile(NAMED + r"(?:" + SIGN + r"|[ \t]{1,4})[\"']?(([0-9]{3})([ -]?)([0-9]{2})\3([0-9]{4}))(?![0-9])").match
NUMBER_AT = re.compile(NAMED + r"(?:" + SIGN + r"|[ \t]{1,4})[\"']?((?=[A-Za-z_-]*[0-9])[A-Za-z0-9](?:[-_]?[A-Za-z0-9])+(?: [0-9][0-9-]*)*)").match
SIGNED_AT = re.compile(NAMED + SIGN + r"(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"'<>,;]+))").match
BARE_AT = re.compile(NAMED + r"[ \t]{1,4}[\"']?([A-Za-z0-9_+/=.-]+)").match
TRAILING = ".,;:!?)*#$%&"


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue.replace(" ", x) for x in ("", " ", "-", "_")}:
                found.add_word(form, (kind, len(form)))
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    found.add_word("://", ("url", 3))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(text: str, start: int, end: int) -> int:
    """The end of the longest IBAN in text[start:end], or -1: groups are taken off the right until the check digits agree."""
    while end > start:
        packed = text[start:end].replace(" ", "").upper()
        if len(packed) < 15:
            return -1
        if int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1:
            return end
        end = text.rfind(" ", start, end)
    return -1


def identifier(kind: str, text: str, at: int) -> tuple[int, int] | None:
    """The identifier that follows a cue of the kind that ends at `at`, as (start, end)."""
    if kind == "iban":
        m = IBAN_AT(text, at)
        end = iban(text, m.start(1), m.end(1)) if m else -1
        return (m.start(1), end) if end > 0 else None
    if kind == "ssn":
        m = SSN_AT(text, at)
        given = m and m[2] not in ("000", "666") and m[2] < "900" and m[4] != "00" and m[5] != "0000"
        return m.span(1) if given else None
    if kind == "number":
        if (got := identifier("iban", text, at)) is not None:
            return got
        m = NUMBER_AT(text, at)
        return m.span(1) if m and len(m[1]) >= 6 and sum(c in DIGITS for c in m[1]) >= 4 else None
    if m := SIGNED_AT(text, at):
        start, end = m.span(m.lastindex)
        if m.lastindex == 3:
            end = start + len(m[3].rstrip(TRAILING))
            # in prose a short word after a colon is no secret: it takes a digit or a mark
            if end - start < 16 and text[start:end].isalpha() and "=" not in text[at:start]:
                return None
        return (start, end) if end - start >= 6 else None
    if m := BARE_AT(text, at):
        value = m[1].rstrip("=.")
        if len(value) >= 16 and any(c in DIGITS for c in value) and any(c.isalpha() for c in value):
            return m.start(1), m.start(1) + len(value)
    return None


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, in order; offsets in code points, end exclusive."""
    if not text:
        return []
    out = []
    after = dict.fromkeys(KINDS, 0)
    for last, (cue, width) in anchors().iter(text.translate(LOWER)):
        at = last - width + 1
        if cue == "digit":
            if at and text[at - 1] in DIGITS:
                continue
            if at >= after["ip"] and (m := IP_AT(text, at)):
                after["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((at, 1, m.end()))
            if at >= after["card"] and (m := CARD_AT(text, at)):
                after["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, m.end()))
        elif cue == "email":
            start = at
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN_AT(text, at + 1)):
                after["email"] = m.end()
                out.append((start, 0, m.end()))
        elif cue == "phone":
            if at >= after["phone"] and (m := PHONE_AT(text, at)):
                after["phone"] = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((at, 3, m.end()))
        elif cue == "url":
            start = at
            while start > after["url"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := HOST_AT(text, at + 3)):
                end = m.end()
                if m := URL_AT(text, end):
                    end += len(m[0].rstrip(TRAILING))
                after["url"] = end
                out.append((start, 4, end))
        elif at >= after["account"] and not (at and text[at - 1].isalpha() and text[at - 1].islower() == text[at].islower()) and (got := identifier(cue, text, last + 1)):
            after["account"] = got[1]
            out.append((got[0], 5, got[1]))
    return sorted(out)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, and spans as an array of (kind, start, end) structs."""

    def make(ids, texts):
        return [ids, [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t)] for t in texts]]

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_columns(d, make, "id long, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def redact(text: str | None) -> str | None:
    """text with each span replaced by its kind in angle brackets; overlapping spans go together."""
    if not text:
        return text
    out, at = [], 0
    for start, kind, end in find_spans(text):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def make(ids, texts):
        found = [find_spans(t) for t in texts]
        counts = [[sum(s[1] == k for s in spans) for spans in found] for k in range(BASE)]
        sha = [hashlib.sha256(render([s for s in spans if s[1] < BASE]).encode()).hexdigest() for spans in found]
        return [ids, *counts, sha, [render(spans) for spans in found]]

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(d, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
