"""Secrets in texts: fixed patterns, and guess costs of the values in credential contexts.

``scan`` finds spans of four kinds.  The base kinds are plain patterns, leftmost and
non-overlapping within a kind, matches that fail their length consumed without retry:
``assign`` (a cue, a separator and a value of 6 or more characters; the span is the whole
match), ``access`` (``AKIA`` and capitals or digits, 20 or more characters) and ``hex``
(24 or more of 0-9a-f).  The added kind ``credential`` is the value after a wider set of
cues and separators (also ``://user:value@`` and ``bearer value``), where it costs a
guesser ``min_bits`` or more and lies in no base span.

The cost is that of the cheapest segmentation of the value into words, dates, repeats,
keyboard walks and brute-force spans, found by dynamic programming over its bytes, in
bits (log2 of the number of guesses):

- a word costs log2(total / count) by its frequency among the letter runs of all texts, or
  the log2 of its place in ``COMMON``; capitals and look-alike digits cost extra;
- a date costs log2 of the days of 200 years, a year alone log2(200);
- a repeat costs one unit by brute force and the log2 of its copies (periods to ``PERIOD``);
- a walk costs its first key, its length and its turns; runs of neighbouring letters or
  digits (``abcd``, ``4321``) are walks too;
- each brute-force byte costs log2 of the size of the value's character classes.

Words are counted over all texts: the substrings of the found values, as 64-bit hashes,
are the only words asked for, so a filter of at most 8 MB goes to the tasks and what is
shuffled follows the values, not the corpus.  Two different words share a hash with
probability of about m * n / 2**64 for m substrings and n words of the corpus.

Offsets are code points, ends exclusive.  Null and empty texts have no spans; very long
texts and values are scanned whole, in linear time; equal rows give equal results, one
row each, null doc_ids included; an empty table gives no rows; further columns, of any
name, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import bit_filter, written
from .textbatch import batch_bytes, chunks, prefix_hash, span_hash

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "credential")

#: a credential must cost so many bits, a random value of 8 lower-case letters costs 37.6
MIN_BITS = 36.0
#: words of a value have so many bytes
SHORT, LONG = 3, 24
#: the longest unit of a repeat
PERIOD = 32
#: rows of one value are dealt to so many tasks
SALTS = 16

# fixed values: cues of credentials, and the words that guessers try first
CUES = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key", "credential", "credentials", "auth")
COMMON = ("password", "qwerty", "admin", "letmein", "welcome", "monkey", "dragon", "master", "login", "secret", "iloveyou", "football", "shadow", "sunshine", "princess", "hunter", "root", "test", "guest", "default", "changeme", "pass", "user", "server", "hello", "freedom", "whatever", "trustno", "superman", "batman")
# fixed values: rows of a keyboard, each with the half keys by which it is shifted
ROWS = (("`1234567890-=", 0), ("qwertyuiop[]\\", 3), ("asdfghjkl;'", 4), ("zxcvbnm,./", 5))
LOOKS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_VALUE = rb"([^\x20\x09-\x0D\"'`<>]{6,})"
_CREDENTIAL = re.compile(
    rb"(?:" + b"|".join(re.escape(c.encode()) for c in sorted(CUES, key=len, reverse=True)) + rb")[\"']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+(?:is|was)\x20+)[\"'`]?" + _VALUE
    + rb"|bearer\x20+" + _VALUE + rb"|://[^\x20\x09-\x0D/@:?#]+:([^\x20\x09-\x0D/]{6,})@[a-z0-9]"
)
_TAIL = b".,;:!?)]}"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _a, _b in LOOKS.items():
    _FOLD[ord(_a)] = ord(_b)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_KEYS = {ord(c): (2 * x + shift, y) for y, (row, shift) in enumerate(ROWS) for x, c in enumerate(row)}
_DATES = [
    re.compile(rb"(?=((?:19|20)[0-9]{2}([-/._]?)(?:0?[1-9]|1[0-2])\2(?:[12][0-9]|3[01]|0?[1-9])))"),
    re.compile(rb"(?=((?:[12][0-9]|3[01]|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:(?:19|20)[0-9]{2}|[0-9]{2})))"),
    re.compile(rb"(?=((?:1[0-2]|0?[1-9])([-/._]?)(?:[12][0-9]|3[01]|0?[1-9])\2(?:(?:19|20)[0-9]{2}|[0-9]{2})))"),
]
_YEAR = re.compile(rb"(?=((?:19|20)[0-9]{2}))")


def found_in(raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind's place in KINDS, end, value's start, value's end) in bytes, sorted; credentials are unjudged."""
    low, out = raw.lower(), []
    out += [(m.start(), 0, m.end(), *m.span(1)) for m in _ASSIGN.finditer(low) if m.end() - m.start(1) >= 6]
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        out += [(m.start(), kind, m.end(), *m.span()) for m in pattern.finditer(raw) if m.end() - m.start() >= 20]
    base = sorted((s, e) for s, _, e, _, _ in out)
    reach, ends = [], 0  # furthest end of the base spans up to each
    for _, e in base:
        ends = max(ends, e)
        reach.append(ends)
    starts = np.array([s for s, _ in base])
    for m in _CREDENTIAL.finditer(low):
        s, e = m.span(m.lastindex)
        e = s + len(low[s:e].rstrip(_TAIL))
        at = int(np.searchsorted(starts, s, "right")) - 1
        if e - s >= 6 and (at < 0 or reach[at] < e):
            out.append((s, 3, e, s, e))
    return sorted(out)


def _points(raw: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    at, n, out = 0, 0, {}
    for o in sorted(set(offsets)):
        n += o - at if raw.isascii() else len(raw[at:o].decode(errors="replace"))
        at, out[o] = o, n
    return out


def substrings(value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of each stretch of SHORT to LONG letters of the folded value."""
    v = _FOLD[np.frombuffer(value, np.uint8)]
    h, run = prefix_hash(v), np.concatenate([[0], np.cumsum(~_LETTER[v])])
    parts = []
    for k in range(SHORT, min(LONG, len(v)) + 1):
        i = np.flatnonzero(run[k:] == run[:-k])
        parts.append((i, np.full(len(i), k), span_hash(h, i, i + k).view(np.int64)))
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64))


def _word_hash(word: str) -> int:
    v = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_hash(v), np.array([0]), np.array([len(v)])).view(np.int64)[0])


_COMMON = {_word_hash(w): math.log2(i + 1) for i, w in enumerate(COMMON)}


def _spelling(piece: bytes) -> float:
    """Bits of a word's capitals and look-alikes."""
    upper, letters = sum(65 <= c < 91 for c in piece), sum(bool(_LETTER[c]) for c in piece)
    capitals = 0 if not upper else 1 if upper == letters or (upper == 1 and 65 <= piece[0] < 91) else letters
    return capitals + len(piece) - letters


def _runs(ok: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _class_bits(value: bytes) -> float:
    v = np.frombuffer(value, np.uint8)
    digit, lower, upper, high = (v >= 48) & (v < 58), (v >= 97) & (v < 123), (v >= 65) & (v < 91), v >= 128
    size = 10 * digit.any() + 26 * lower.any() + 26 * upper.any() + 128 * high.any() + 33 * (~(digit | lower | upper | high)).any()
    return math.log2(max(size, 2))


def segments(value: bytes, words: dict[int, float]) -> tuple[float, list[tuple[str, int, int]]]:
    """The least bits of a guess, and the (kind, start, end) of its segments; words has bits by hash."""
    n, brute = len(value), _class_bits(value)
    ending: dict[int, list[tuple[int, float, str]]] = {}

    def add(kind: str, s: int, e: int, bits: float) -> None:
        ending.setdefault(e, []).append((s, bits + 1, kind))

    at, size, hashes = substrings(value)
    for i in np.flatnonzero(np.isin(hashes, np.array([*words, *_COMMON], np.int64))):
        s, e, h = int(at[i]), int(at[i] + size[i]), int(hashes[i])
        add("word", s, e, min(words.get(h, 1e9), _COMMON.get(h, 1e9)) + _spelling(value[s:e]))
    for pattern in _DATES:
        for m in pattern.finditer(value):
            if m.end(1) - m.start(1) >= 6:
                add("date", *m.span(1), math.log2(365 * 200) + 2 * bool(m[2]))
    for m in _YEAR.finditer(value):
        add("date", *m.span(1), math.log2(200))
    v = np.frombuffer(value, np.uint8)
    for p in range(1, min(PERIOD, n // 2) + 1):
        for s, e in _runs(v[p:] == v[:-p]):
            if e - s >= max(p, 2):
                add("repeat", int(s), int(e) + p, p * brute + math.log2((e - s + p) / p))
    low = value.lower()
    step = np.diff(v.astype(np.int16))
    alike = np.concatenate([[False], _LETTER[v[1:]] == _LETTER[v[:-1]]])[1:] & ((v[1:] < 128) & (v[:-1] < 128)) if n > 1 else np.zeros(0, bool)
    for by in (1, -1):
        for s, e in _runs((step == by) & alike):
            if e - s >= 2:
                add("walk", int(s), int(e) + 1, brute + math.log2(e - s + 1) + 1)
    s, turns, was = 0, 0, None
    for i in range(1, n + 1):
        a, b = _KEYS.get(low[i - 1]), _KEYS.get(low[i]) if i < n else None
        way = (b[0] - a[0], b[1] - a[1]) if a and b else None
        if way and abs(way[0]) <= 2 and abs(way[1]) <= 1 and way != (0, 0):
            turns += way != was
            was = way
            continue
        if i - s >= 4:
            add("walk", s, i, math.log2(len(_KEYS)) + math.log2(i - s) + turns * math.log2(6) + _spelling(value[s:i]) * (value[s:i].lower() != value[s:i]))
        s, turns, was = i, 0, None
    cost, back = [0.0], [(0, "")]
    for e in range(1, n + 1):
        best = (cost[e - 1] + brute, e - 1, "brute")
        for s, bits, kind in ending.get(e, ()):
            best = min(best, (cost[s] + bits, s, kind))
        cost.append(best[0])
        back.append(best[1:])
    out, e = [], n
    while e:
        s, kind = back[e]
        if out and kind == "brute" == out[-1][0]:
            out[-1] = (kind, s, out[-1][2])
        else:
            out.append((kind, s, e))
        e = s
    return cost[n], out[::-1]


def _letter_runs(texts: pa.Array) -> np.ndarray:
    """Hashes of the letter runs of SHORT to LONG bytes, and one 0 for every other run."""
    data, offsets = batch_bytes(texts)
    inside = np.zeros(len(data) + 2 + len(offsets), bool)
    shifted = np.arange(len(data)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) + 1  # a gap after each text
    inside[shifted] = _LETTER[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    place = np.searchsorted(shifted, edge + 1)
    start, end = place[::2], place[1::2]
    low = data.copy()
    low[(data >= 65) & (data < 91)] += 32
    out = np.zeros(len(start), np.int64)
    ok = (end - start >= SHORT) & (end - start <= LONG)
    out[ok] = span_hash(prefix_hash(low), start[ok], end[ok]).view(np.int64)
    return out


def word_bits(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, bits: of the wanted hashes (h, distinct), those that are words of docs, by their frequency in all of docs."""
    passes = bit_filter(wanted)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(b, "text"):
                h = _letter_runs(part.column(0))
                kept, n = np.unique(h[passes(h)], return_counts=True)
                yield pa.record_batch([pa.array([None, *kept], pa.int64()), pa.array([len(h), *n], pa.int64())], names=["h", "n"])

    counts = written(docs.select("text").mapInArrow(task, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.where("h is null").selectExpr("n as total")  # one row, none of an empty table
    known = counts.join(wanted, "h").join(F.broadcast(total), F.lit(True))
    return known.select("h", F.log2(F.col("total") / F.col("n")).alias("bits"))


def _salted(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """An inner join on key, where rows of one key of left go to several tasks by the column ``by``."""
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [key, "salt"]).drop("salt")


def costs(docs: DataFrame, values: DataFrame) -> DataFrame:
    """value (binary, distinct), bits: the guess cost of each value, words counted over the texts of docs."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v in b.column(0).to_pylist():
                h = np.unique(substrings(v)[2])
                yield pa.record_batch([pa.array([v] * len(h), pa.binary()), pa.array(h)], names=["value", "h"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [segments(v, {w["h"]: w["bits"] for w in ws or ()})[0] for v, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(bits, pa.float64())], names=["value", "bits"])

    parts = written(values.select("value").mapInArrow(explode, "value binary, h long"))
    words = word_bits(docs, parts.select("h").distinct())
    # a value has at most LONG substrings a byte, so its list follows its own length
    known = _salted(parts, words, "h", "value").groupBy("value").agg(F.collect_list(F.struct("h", "bits")).alias("words"))
    return values.select("value").join(known, "value", "left").mapInArrow(judge, "value binary, bits double")


_FOUND = "at long, doc_id long, spans array<struct<kind:string,start:long,end:long,value_start:long,value_end:long,value:binary>>"
SPANS = "array<struct<kind:string,start:long,end:long,value_start:long,value_end:long,bits:double>>"


def candidates(docs: DataFrame) -> DataFrame:
    """at (a row's number), doc_id, spans of every row with the bytes of their values; credentials are unjudged."""
    item = pa.struct([("kind", pa.string()), *((k, pa.int64()) for k in ("start", "end", "value_start", "value_end")), ("value", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(2).cast(pa.binary()).to_pylist():
                found = found_in(raw) if raw else []
                to = _points(raw, [o for s, _, *more in found for o in (s, *more)]) if found else {}
                out.append([{"kind": KINDS[k], "start": to[s], "end": to[e], "value_start": to[vs], "value_end": to[ve], "value": raw[vs:ve]} for s, k, e, vs, ve in found])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.list_(item))], names=["at", "doc_id", "spans"])

    return docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _FOUND)


def scan(docs: DataFrame, min_bits: float = MIN_BITS) -> DataFrame:
    """doc_id and spans (kind, start, end, the value's start and end, its guess cost), by start, then kind as in KINDS."""
    rows = written(candidates(docs))
    each = rows.where("size(spans) > 0").select("at", "doc_id", F.posexplode("spans").alias("i", "s")).select("at", "doc_id", "i", "s", F.col("s.value").alias("value"))
    judged = _salted(each, costs(docs, each.select("value").distinct()), "value", "at")
    fields = ["kind", "start", "end", "value_start", "value_end"]
    span = F.struct("i", *[F.col(f"s.{f}").alias(f) for f in fields], "bits")
    # spans stand in one row per text, as many as the text has
    lists = judged.groupBy("at", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    kept = F.filter("spans", lambda s: (s["kind"] != "credential") | (s["bits"] >= min_bits))
    spans = F.transform(kept, lambda s: F.struct(*[s[f].alias(f) for f in fields], s["bits"].alias("bits")))
    return rows.where("size(spans) = 0").select("doc_id", F.array().cast(SPANS).alias("spans")).unionByName(lists.select("doc_id", spans.cast(SPANS).alias("spans")))
