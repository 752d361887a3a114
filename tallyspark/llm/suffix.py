"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte of a text is removed when a string of ``LENGTH`` bytes that covers it also starts
elsewhere in the corpus (in another text or the same one; overlaps count; strings are
those of the input, and never cross texts).  ``keep_first`` leaves the first start of
each string, in the order of documents' ids and places, so that later copies go and the
first stays.

One suffix array of a corpus doesn't fit a machine, so suffixes that can match are first
brought together:
 1. Anchors.  In each ``LENGTH`` bytes, the place with the least hash of ``GRAM`` bytes is an
    anchor (ties: all).  Equal strings have equal anchors at equal places, so equal strings
    always meet in the block of their anchor's hash.  Texts that occur often are read once.
 2. Blocks.  Anchors go to blocks by hash (as many as the input's bytes ask for), with a hash of
    their surroundings (all bytes of the strings that hold the anchor).  Anchors met once are
    done; surroundings that repeat as a whole need no byte again.  An anchor with more than
    ``LARGE`` kinds of surroundings is split by the bytes that the strings reaching mostly to
    its right, or mostly to its left, have in common.
 3. Suffixes.  Anchors with differing surroundings, one of each kind, have their bytes fetched.
    A slice's suffixes that start at anchors are put in order, and so are the mirrored
    prefixes that end there.  In either order the previous and the next smaller position (in
    time) give the longest previous factor, and the greater ones the longest next factor.
    The string that starts l bytes before an anchor can repeat only if the factor to the right
    reaches ``LENGTH`` - l and that to the left l.  Where both do, common prefixes of neighbours
    cut both orders into classes, and strings in the same two classes are equal.
 4. Removal.  Removed stretches of each text are united and cut out.

Bytes decide in step 3.  Whole surroundings are equal by two 64-bit hashes (of the anchor and
of all the bytes), equal texts by one with the length mixed in: of 10**9 distinct texts about
0.03 pairs, of 5 * 10**10 (100 TB) about 70, are expected to be taken for equal by chance.
A group that shares one anchor and half of its surroundings in more than some 10**6 kinds still
meets in one task, about 1 KB for each.

A null text is an empty one; empty and short texts lose nothing; equal documents are
repeats of each other; equal doc_ids are separate documents; an empty table gives no rows;
further columns are ignored.  What is left is bytes: a cut may split a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written
from .textbatch import batch_bytes, chunks, mix, prefix_hash, span_hash

LENGTH = 400
GRAM = 64
#: bytes of text whose anchors one block holds
BLOCK_BYTES = 1 << 19
#: bytes of surroundings that one pair of suffix orders takes
SLICE = 3 << 19
#: kinds of surroundings from which on an anchor's group is split
LARGE = 2048
ANCHOR = np.dtype([("anchor", "<u8"), ("around", "<u8"), ("ahead", "<u8"), ("behind", "<u8"), ("text", "<i8"), ("doc", "<i8"), ("place", "<i4"), ("left", "<i4"), ("right", "<i4")])
#: which strings of an anchor a group compares: those reaching mostly right, mostly left, or all
RIGHT, LEFT, BOTH = 0, 1, 2


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    m, step = h, 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text index, place, anchor hash, surroundings' hash, hashes of the bytes common to strings
    that reach mostly right and mostly left (0 if there are none), bytes left, bytes right)."""
    h = prefix_hash(data)
    at = np.arange(max(0, len(data) - gram + 1))
    hashes = span_hash(h, at, at + gram)
    width = length - gram + 1
    chosen = np.zeros(len(data), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a < length:
            continue
        g = hashes[a : b - gram + 1]
        low = window_min(g, width)
        # the least value that any window over a place has is its own: it is some window's anchor
        pad = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
        most = ~window_min(~np.concatenate([pad ^ pad, low, pad ^ pad]), width)
        chosen[a : b - gram + 1] = g == most
    place = np.flatnonzero(chosen)
    doc = np.searchsorted(offsets, place, "right") - 1
    start = np.maximum(offsets[doc], place - (length - gram))
    end = np.minimum(offsets[doc + 1], place + length)
    around = span_hash(h, start, end) ^ mix((place - start).astype(np.uint64) * np.uint64(100003) + (end - place).astype(np.uint64))
    half = (length - gram) // 2
    ahead, behind = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
    ok = end - place >= length - half
    ahead[ok] = span_hash(h, place[ok], place[ok] + length - half) | np.uint64(1)
    ok = place - start > half
    behind[ok] = span_hash(h, place[ok] - half - 1, place[ok] + gram) | np.uint64(1)
    return doc, place - offsets[doc], hashes[place], around, ahead, behind, place - start, end - place


def anchor_blocks(texts: DataFrame, length: int, gram: int, n_blocks: int) -> DataFrame:
    """block, entries of the anchors of each task's distinct texts; texts: cls, doc_id, text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def pack(held: list[np.ndarray]) -> pa.RecordBatch:
            e = np.concatenate(held)
            block = (mix(e["anchor"]) % np.uint64(n_blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            e, block = e[order], block[order]
            start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            end = np.append(start[1:], len(e))
            return pa.record_batch([pa.array(block[start].astype(np.int32)), pa.array([e[x:y].tobytes() for x, y in zip(start, end)], pa.binary())], names=["block", "entries"])

        held, total = [], 0
        for batch in batches:
            new = []
            for c in batch.column(0).to_pylist():
                new.append(c not in seen)
                seen.add(c)
            batch = batch.filter(pa.array(new, pa.bool_()))
            for b in chunks(batch, "text"):
                data, offsets = batch_bytes(b.column(2))
                doc, place, anchor, around, ahead, behind, left, right = anchors(data, offsets, length, gram)
                if not len(doc):
                    continue
                e = np.empty(len(doc), ANCHOR)
                e["text"] = b.column(0).to_numpy()[doc]
                e["doc"] = b.column(1).fill_null(-(1 << 63)).to_numpy()[doc]
                e["anchor"], e["around"], e["place"], e["left"], e["right"] = anchor, around, place, left, right
                e["ahead"], e["behind"] = ahead, behind
                held.append(e)
                total += len(e)
                if total > 1 << 18:
                    yield pack(held)
                    held, total = [], 0
        if held:
            yield pack(held)

    return texts.mapInArrow(task, "block int, entries binary")


FOUND = "cls long, start int, stop int, wanted boolean, key long, side int, doc_id long, place int"


def meet(blocked: DataFrame, length: int, keep_first: bool, large: int = LARGE) -> DataFrame:
    """wanted false: stretches [start, stop) of texts that repeat as a whole; wanted true: one
    anchor of each surrounding in groups with several, whose bytes have to be compared."""

    def emit(e: np.ndarray, wanted: bool, key: np.ndarray, side: int) -> pa.RecordBatch:
        cols = [e["text"], e["place"] - e["left"], e["place"] + e["right"], np.full(len(e), wanted), key.view(np.int64), np.full(len(e), side, np.int32), e["doc"], e["place"]]
        return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in cols], names=["cls", "start", "stop", "wanted", "key", "side", "doc_id", "place"])

    def work(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        e = e[np.lexsort((e["doc"], e["place"], e["text"], e["around"], e["anchor"]))]
        same = np.append(False, (e["text"][1:] == e["text"][:-1]) & (e["place"][1:] == e["place"][:-1]) & (e["around"][1:] == e["around"][:-1]))
        e = e[~same]  # the least document of a text stands for it
        e = e[np.lexsort((e["place"], e["doc"], e["around"], e["anchor"]))]
        new_group = np.append(True, e["anchor"][1:] != e["anchor"][:-1])
        new_kind = new_group | np.append(True, e["around"][1:] != e["around"][:-1])
        kind = np.cumsum(new_kind) - 1
        many = np.bincount(kind)[kind] > 1
        whole = many & (e["left"] + e["right"] >= length)
        gone = whole & ~new_kind if keep_first else whole
        yield emit(e[gone], False, e["anchor"][gone], BOTH)
        group = np.cumsum(new_group) - 1
        kinds = np.bincount(group, weights=new_kind)[group]
        some = e[new_kind & (kinds > 1) & (kinds <= large)]
        yield emit(some, True, some["anchor"], BOTH)
        many = e[new_kind & (kinds > large)]
        for side, common in ((RIGHT, "ahead"), (LEFT, "behind")):
            part = many[many[common] != 0]
            key = mix(part["anchor"] ^ mix(part[common] + np.uint64(side)))
            _, of, n = np.unique(key, return_inverse=True, return_counts=True)
            yield emit(part[n[of] > 1], True, key[n[of] > 1], side)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != now and held:
                    yield from work(np.concatenate(held))
                    held = []
                now = block
                held.append(np.frombuffer(data.as_buffer(), dtype=ANCHOR))
        if held:
            yield from work(np.concatenate(held))

    return blocked.repartition("block").sortWithinPartitions("block").mapInArrow(task, FOUND)


def in_order(rows: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows (byte strings of the given sizes, filled up with 0xFF, which no UTF-8 text
    has) in suffix order by group, and each one's common prefix with the one before, -1 at a
    group's first."""
    n, width = rows.shape
    keyed = np.empty((n, 8 + width), np.uint8)
    keyed[:, :8] = group.astype(">u8").view(np.uint8).reshape(n, 8)
    keyed[:, 8:] = rows
    order = np.argsort(keyed.view(f"S{8 + width}").ravel(), kind="stable")
    sorted_rows, g, s = rows[order], group[order], size[order]
    lcp = np.full(n, -1, np.int64)
    differs = sorted_rows[1:] != sorted_rows[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    lcp[1:] = np.where(g[1:] == g[:-1], np.minimum(first, np.minimum(s[1:], s[:-1])), -1)
    return order, lcp


def factors(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, longest next factor) of each row; rows are numbered in time.

    The longest match with an earlier row is the previous or the next smaller position's in
    suffix order, the longest with a later row the previous or next greater one's.
    """
    n = len(order)
    out = []
    for time in (order, n - 1 - order):
        best = np.full(n, -1, np.int64)
        for t, c in ((time, lcp), (time[::-1], np.append(lcp[1:], -1)[::-1])):
            at, low = np.arange(n) - 1, c.copy()
            while True:
                # a candidate that isn't smaller hands on its own candidate, behind which all are greater
                ask = np.flatnonzero(at >= 0)
                ask = ask[(t[at[ask]] > t[ask]) & (low[ask] >= 0)]
                if not len(ask):
                    break
                via = at[ask]
                low[ask], at[ask] = np.minimum(low[ask], low[via]), at[via]
            found = np.where(at >= 0, low, -1)
            best = np.maximum(best, found if c is lcp else found[::-1])
        factor = np.empty(n, np.int64)
        factor[order] = best
        out.append(factor)
    return out[0], out[1]


def repeated_strings(ahead: np.ndarray, right: np.ndarray, behind: np.ndarray, left: np.ndarray, group: np.ndarray, side: np.ndarray, length: int, gram: int, keep_first: bool) -> np.ndarray:
    """hit[row, l]: whether the string that starts l bytes before the row's anchor repeats (or, for
    keep_first, has an earlier copy).  Rows are numbered in time; behind is mirrored."""
    n, most, half = len(group), length - gram, (length - gram) // 2
    hit = np.zeros((n, most + 1), bool)
    r_order, r_lcp = in_order(ahead, right, group)
    l_order, l_lcp = in_order(behind, left, group)
    (r_before, r_after), (l_before, l_after) = factors(r_order, r_lcp), factors(l_order, l_lcp)
    low = np.maximum(length - np.maximum(r_before, r_after), np.where(side == LEFT, half + 1, 0))
    high = np.minimum(np.maximum(l_before, l_after), np.where(side == RIGHT, half, most))
    some = np.flatnonzero(low <= high)
    if not len(some):
        return hit
    names = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for i in range(int(low[some].min()), int(high[some].max()) + 1):
        act = some[(low[some] <= i) & (i <= high[some])]
        if len(act) < 2:
            continue
        names[0][r_order] = np.cumsum(r_lcp < length - i)
        names[1][l_order] = np.cumsum(l_lcp < i)
        name = names[0][act] * (n + 1) + names[1][act]
        by = np.argsort(name, kind="stable")
        same = name[by][1:] == name[by][:-1]
        copy = np.append(False, same) if keep_first else np.append(False, same) | np.append(same, False)
        hit[act[by[copy]], i] = True
    return hit


def compare(wanted: DataFrame, length: int, gram: int, keep_first: bool) -> DataFrame:
    """Removed stretches cls, start, stop from wanted anchors: key, side, cls, doc_id, start, place, bytes."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        key, side, cls, doc, start, place = (t.column(i).to_numpy() for i in range(6))
        data = t.column(6).chunk(0).cast(pa.large_binary())
        offset = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1 + data.offset)[data.offset :]
        flat = np.frombuffer(data.buffers()[2], np.uint8)
        time = np.lexsort((place, cls, doc))
        group = np.unique(key, return_inverse=True)[1][time]
        side, cls, start, place = side[time], cls[time], start[time], place[time]
        left = (place - start).astype(np.int64)
        right = np.diff(offset)[time] - left
        at = offset[:-1][time] + left

        def window(step: np.ndarray, size: np.ndarray, sign: int) -> np.ndarray:
            inside = step[None, :] < size[:, None]
            where = at[:, None] + (step if sign > 0 else -1 - step)[None, :]
            return np.where(inside, flat[np.where(inside, where, 0)], np.uint8(255))

        hit = repeated_strings(window(np.arange(length), right, 1), right, window(np.arange(length - gram), left, -1), left, group, side, length, gram, keep_first)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        cols = [cls[row], (place[row] - last).astype(np.int32), (place[row] - first + length).astype(np.int32)]
        return pa.record_batch([pa.array(c) for c in cols], names=["cls", "start", "stop"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            border = np.flatnonzero(np.append(now is None or key[0] != now, key[1:] != key[:-1]))
            now = key[-1]
            # groups stay whole: a slice ends at the last border once it is long enough
            if size > SLICE and len(border):
                cut = int(border[-1])
                if cut:
                    held.append(batch.slice(0, cut))
                yield work(held)
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield work(held)

    rows = wanted.select("key", "side", "cls", "doc_id", "start", "place", "bytes").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(task, "cls long, start int, stop int")


def stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, large: int = LARGE) -> DataFrame:
    """doc_id, text, n_bytes, all (the whole text goes) and cut (stretches that go, by start)."""
    if gram >= length:
        raise ValueError("anchors must be shorter than the strings")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.xxhash64(text, F.octet_length(text)).alias("cls"), "doc_id", text.alias("text"))
    long = docs.where(F.octet_length("text") >= length)
    n_blocks = max(64, (long.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BLOCK_BYTES)
    found = written(meet(anchor_blocks(long, length, gram, n_blocks), length, keep_first, large))
    whole = found.where("not wanted").select("cls", "start", "stop")
    texts = long.select("cls", F.col("text").cast("binary").alias("data")).dropDuplicates(["cls"])
    part = F.substring("data", F.col("start") + 1, F.col("stop") - F.col("start")).alias("bytes")
    wanted = found.where("wanted").join(texts, "cls").select("key", "side", "cls", "doc_id", "start", "place", part)
    gone = whole.unionByName(written(compare(wanted, length, gram, keep_first)))
    # equal documents: all bytes of long ones repeat
    groups = long.groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    cut = gone.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cut"))
    per_text = groups.join(cut, "cls", "left").where("copies > 1 or cut is not null")
    rows = docs.join(per_text, "cls", "left")
    copy = F.col("copies") > 1 if not keep_first else (F.col("copies") > 1) & (F.col("doc_id") != F.col("first"))

    return rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce(copy, F.lit(False)).alias("all"), "cut")


def united(n: int, whole: bool, cut: list[dict] | None) -> list[list[int]]:
    """Maximal removed runs [start, stop)."""
    spans: list[list[int]] = [[0, n]] if whole else []
    for x in () if whole else cut or ():
        if spans and x["start"] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], x["stop"])
        else:
            spans.append([x["start"], x["stop"]])
    return spans


def remove(found: DataFrame) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, spans (maximal removed runs
    [start, stop) of the UTF-8 bytes) of the frame of ``stretches``."""
    item = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed, runs = [], [], []
            for text, n, whole, cut in zip(b.column(1), *(b.column(i).to_pylist() for i in (2, 3, 4))):
                spans = united(n, whole, cut)
                data, at, parts = memoryview(text.as_buffer()), 0, []
                for start, stop in spans:
                    parts.append(data[at:start])
                    at = stop
                kept.append(b"".join([*parts, data[at:]]))
                removed.append(n - len(kept[-1]))
                runs.append([{"start": x, "stop": y} for x, y in spans])
            yield pa.record_batch([b.column(0), pa.array(kept, pa.binary()), b.column(2), pa.array(removed, pa.int64()), pa.array(runs, item)], names=["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    return found.mapInArrow(task, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>")
