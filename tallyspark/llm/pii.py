"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes
and identifier cues) in a single pass over a text; a deterministic parser for
each kind then expands the span from its anchor and validates it.  Texts without
anchors cost one automaton pass.

Base kinds, leftmost and non-overlapping within a kind, failing matches consumed
without retry: ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19 digits,
Luhn), ``phone`` (8 to 15 digits).  Added kinds: ``url`` (an address with user
information before its host), ``account`` (a value after an account, IBAN,
passport or social-security cue) and ``secret`` (a value of 16 or more characters
after a token, key or password cue and ``=`` or ``:``).

Offsets are code points, ends exclusive.  Null and empty texts have no spans;
very long texts are scanned whole, in time linear in their length; equal rows
give equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

# fixed values: cues that start an identifier or a secret
ACCOUNT_CUES = ("account number", "account no", "acct", "iban", "passport", "ssn", "social security")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key", "private_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"://[^\x20\x09-\x0D/@:?#]+(?::[^\x20\x09-\x0D/@?#]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\x20\x09-\x0D\"'<>]*)?")
_ACCOUNT = re.compile(r"[\x20#:=.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?|[A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,17})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\x20]{0,2}[:=][\x20]{0,2}[\"']?([A-Za-z0-9+/_.=-]{16,})")
_DIGITS = frozenset("0123456789")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def automaton():
    """The anchors: (kind, length) by pattern; cues in lower, title and upper case."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for s, kind in (("@", "@"), ("+", "+"), ("://", "u"), *((d, "d") for d in "0123456789")):
        a.add_word(s, (kind, len(s)))
    for cues, kind in ((ACCOUNT_CUES, "a"), (SECRET_CUES, "s")):
        for cue in cues:
            for form in {cue, cue.title(), cue.capitalize(), cue.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def find_spans(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in order of its starts."""
    found: dict[str, list[tuple[int, int]]] = {}
    at = {"email": 0, "ip": 0, "card": 0, "phone": 0, "url": 0, "account": 0, "secret": 0}
    run_end = -1

    def add(kind: str, s: int, e: int, ok: bool) -> None:
        at[kind] = e
        if ok:
            found.setdefault(kind, []).append((s, e))

    for last, (kind, size) in anchors.iter(text):
        p = last - size + 1
        if kind == "d":
            if p == run_end:  # inside a run of digits that was tried from its start
                run_end = p + 1
                continue
            run_end = p + 1
            if p >= at["ip"] and (m := _IP.match(text, p)):
                add("ip", p, m.end(), all(map(_byte, m.groups())))
            if p >= at["card"] and (m := _CARD.match(text, p)):
                digits = re.sub(r"[\x20-]", "", m[0])
                add("card", p, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
        elif kind == "@":
            s = p
            while s > at["email"] and text[s - 1] in _LOCAL:
                s -= 1
            if s < p and (m := _DOMAIN.match(text, p + 1)):
                add("email", s, m.end(), True)
        elif kind == "+":
            if p >= at["phone"] and (m := _PHONE.match(text, p)):
                add("phone", p, m.end(), 8 <= sum(c in _DIGITS for c in m[0]) <= 15)
        elif kind == "u":
            s = p
            while s > at["url"] and text[s - 1] in _SCHEME:
                s -= 1
            if s < p and (m := _URL.match(text, p)):
                add("url", s, m.end(), True)
        elif p and (text[p - 1].isalnum() or text[p - 1] == "_") and kind == "a":
            continue
        elif m := (_ACCOUNT if kind == "a" else _SECRET).match(text, last + 1):
            name = "account" if kind == "a" else "secret"
            if m.start(1) >= at[name]:
                add(name, m.start(1), m.end(1), True)
    return found


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans, ordered by kind (as in KINDS), then start."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                found = find_spans(text, anchors) if text else {}
                out.append([{"kind": k, "start": s, "end": e} for k in KINDS for s, e in found.get(k, ())])
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(item))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(task, SPANS)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by ``<kind>``; of overlapping ones the first stays."""
    parts, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"<{kind}>"]
            at = e
    return "".join([*parts, text[at:]])


def digest_column(kinds: tuple[str, ...]):
    """``kind:start:end`` of the given kinds, comma-joined."""
    from pyspark.sql import functions as F

    kept = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
