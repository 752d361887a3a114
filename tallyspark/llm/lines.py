"""Line deduplication by a segment-partition edit join.

A text's lines are split at line feeds; lines without a word are never removed.  A line goes
when an earlier one (in the order of doc_id, then the text's hash, then line number) is equal
to it, or is within ``EDITS`` edits of it (code points; both of ``MIN_CHARS`` or more).

Two lines within t edits share, after cutting the shorter one into t + 1 segments, at least
one segment that stands in the longer one at nearly its place.  So every distinct line gives
its own segments as index entries and, for each length up to t less, the few substrings at
which a segment of such a line could stand (the multi-match-aware choice) as probes; entries
are keyed by segment number, length and hash, packed into blocks and met per block.  Pairs of
an index entry and another entry that agree are compared by their character counts first
(each edit moves two at most), then verified with a banded bit-parallel automaton: t + 1 bit
vectors of 2t + 1 bits, many pairs at once.

A line goes by one earlier line, so a line needs no pair with each of a large group of near
lines.  Entries carry the place of their line's first document (``Order``); where entries agree,
a line meets its ``FEW`` earliest candidates.  Those that had more and have no near line among
them are compared with all earlier lines of their keys, by exact place, inside tasks: a key's
lines travel in slices of ``SLICE`` code points, two slices meet in a row, and what comes out is
a line, not a pair.  So rows grow with lines; a key of very many lines that aren't near costs
comparisons.

Equal lines are joined by a 128-bit hash, pre-aggregated in each task, so that a line of a
third of all texts is a few rows a task.  Entries and pairs are of distinct lines only.
Lines' texts travel only for pairs.

A null text stays null; empty texts stay; equal documents (same id and text) count as one
and lose the same lines; a line that repeats within its text goes too; very long lines are
compared whole; an empty table gives no rows; further columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import bit_filter, written
from .textbatch import BASE, BASE_INV, batch_bytes, chunks, mix, powers, prefix_hash, span_hash, thrifty

EDITS = 2
MIN_CHARS = 40
#: distinct lines for each block of their entries, and the fewest blocks
BLOCK_LINES, BLOCKS = 1 << 15, 256
#: entries that a task gathers before it deals them to blocks
HELD = 1 << 19
#: candidates that a line meets as pairs, code points of a slice of a key's lines
FEW, SLICE = 2, 1 << 18
WIDE = 64
#: pairs that one comparison step takes
STEP = 1 << 20
ENTRY = np.dtype([("key", "<u8"), ("line", "<i8"), ("bag", "<u8"), ("rank", "<u4"), ("index", "u1")])


class Order:
    """Numbers of 4 bytes in the order of doc_ids from low to high (null first); far ones may be equal."""

    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low or 0, high or 0
        self.shift = max(0, (self.high - self.low).bit_length() - 31)

    def __call__(self, ids: pa.Array) -> np.ndarray:
        x = np.clip(np.asarray(pa.compute.fill_null(ids, self.low), np.int64), self.low, self.high)
        step = (x.view(np.uint64) - np.array(self.low, np.int64).view(np.uint64)) >> np.uint64(self.shift)
        return np.where(np.asarray(pa.compute.is_null(ids)), 0, step + np.uint64(1)).astype(np.uint32)


class Lines:
    """Lines with a word of a batch of texts: bytes, hashes and owners."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, offsets = batch_bytes(texts)
        n = len(self.data)
        cuts = np.flatnonzero(self.data == 10)
        inner = np.repeat(offsets[1:], 1)
        start = np.concatenate([offsets[:-1], cuts + 1])
        end = np.concatenate([inner, cuts])
        order_s, order_e = np.sort(start, kind="stable"), np.sort(end, kind="stable")
        doc = np.searchsorted(offsets[1:], order_s, "right")
        # a start at a text's border belongs to the last text that starts there, an empty line to none
        word = np.concatenate([[0], np.cumsum((self.data != 32) & ~((self.data >= 9) & (self.data <= 13)))])
        ok = (order_e > order_s) & (word[order_e] > word[order_s]) if n else np.zeros(len(order_s), bool)
        number = np.arange(len(order_s))
        docs_before = np.searchsorted(order_s, offsets[:-1], "left")
        self.start, self.end = order_s[ok], order_e[ok]
        self.doc = doc[ok]
        breaks = np.concatenate([[0], np.cumsum(self.data == 10)])
        self.number = (breaks[self.start] - breaks[offsets[:-1][self.doc]]).astype(np.int32)
        h = prefix_hash(self.data)
        self.h1 = span_hash(h, self.start, self.end) ^ mix((self.end - self.start).astype(np.uint64))
        g = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.data.astype(np.uint64) + np.uint64(7919)) * powers(0xD6E8FEB86659FD93, n), out=g[1:])
        back = powers(pow(0xD6E8FEB86659FD93, -1, 1 << 64), n + 1)
        self.h2 = mix((g[self.end] - g[self.start]) * back[self.start])
        del number, docs_before


KEYS = "doc_id long, cls long, line int, h1 long, h2 long"


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, cls, line number and hashes of every line with a word; docs: doc_id, cls, text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                x = Lines(b.column(2))
                at = pa.array(x.doc)
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(x.number), pa.array(x.h1.view(np.int64)), pa.array(x.h2.view(np.int64))], names=["doc_id", "cls", "line", "h1", "h2"])

    return docs.mapInArrow(thrifty(task), KEYS)


def segments(n: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths), a column for each of edits + 1 segments of lines of n code points."""
    k = edits + 1
    short, longer = n // k, n % k
    i = np.arange(k)
    length = short[:, None] + (i >= k - longer[:, None])
    return np.cumsum(length, axis=1) - length, length


def line_entries(texts: list[str], ids: np.ndarray, edits: int, rank: np.ndarray | None = None) -> np.ndarray:
    """Index entries and probes of distinct lines."""
    rank = np.zeros(len(ids), np.uint32) if rank is None else rank
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    mixed = mix(points + np.uint64(0x2545F491))
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers(BASE, len(points)), dtype=np.uint64)])
    back = powers(BASE_INV, len(points) + 1)
    # character counts modulo 16 in 16 classes of 4 bits
    owner = np.repeat(np.arange(len(texts)), size)
    count = np.bincount(owner * 16 + (mixed >> np.uint64(60)).astype(np.int64), minlength=16 * len(texts)).reshape(-1, 16)
    bag = ((count % 16).astype(np.uint64) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)
    out = []

    def add(which: np.ndarray, start: np.ndarray, length: np.ndarray, i: int, of: np.ndarray, index: int) -> None:
        s = first[which] + start
        e = np.empty(len(which), ENTRY)
        label = of.astype(np.uint64) * np.uint64(64) + np.uint64(i)
        e["key"] = mix(mix((h[s + length] - h[s]) * back[s]) ^ (label * np.uint64(0x9E3779B97F4A7C15)))
        e["line"], e["bag"], e["rank"], e["index"] = ids[which], bag[which], rank[which], index
        out.append(e)

    for d in range(edits + 1):  # lines d shorter than this one
        of = size - d
        starts, lengths = segments(of, edits)
        for i in range(edits + 1):
            low = np.maximum(starts[:, i] - i, starts[:, i] + d - (edits - i))
            high = np.minimum(starts[:, i] + i, starts[:, i] + d + (edits - i))
            low, high = np.maximum(low, 0), np.minimum(high, size - lengths[:, i])
            for shift in range(-2 * edits, 2 * edits + 1):
                at = starts[:, i] + shift
                own = d == 0 and shift == 0
                which = np.flatnonzero((at >= low) & (at <= high)) if not own else np.arange(len(size))
                if len(which):
                    add(which, at[which], lengths[which, i], i, of[which], int(own))
    return np.concatenate(out)


def entry_blocks(docs: DataFrame, edits: int, min_chars: int, n_blocks: int, order: Order) -> DataFrame:
    """block, entries of the distinct lines of each stretch of texts; docs: doc_id, text."""

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        e = np.concatenate(held)
        block = (e["key"] % np.uint64(n_blocks)).astype(np.int32)
        by = np.argsort(block, kind="stable")
        e, block = e[by], block[by]
        start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        end = np.append(start[1:], len(e))
        return pa.record_batch([pa.array(block[start]), pa.array([e[p:q].tobytes() for p, q in zip(start, end)], pa.binary())], names=["block", "entries"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        seen, best = np.zeros(0, np.uint64), np.zeros(0, np.uint32)  # lines held, and their ranks
        for batch in batches:
            for b in chunks(batch, "text"):
                x = Lines(b.column(1))
                rank = order(b.column(0))[x.doc]
                by = np.lexsort((rank, x.h1))
                at = by[np.flatnonzero(np.append(True, x.h1[by][1:] != x.h1[by][:-1]))] if len(by) else by
                at = at[x.end[at] - x.start[at] >= min_chars]
                if len(seen):
                    k = np.minimum(np.searchsorted(seen, x.h1[at]), len(seen) - 1)
                    at = at[(seen[k] != x.h1[at]) | (best[k] > rank[at])]
                raw = x.data.tobytes()
                texts = [raw[s:e].decode() for s, e in zip(x.start[at].tolist(), x.end[at].tolist())]
                keep = [len(t) >= min_chars for t in texts]
                texts, at = [t for t, k in zip(texts, keep) if k], at[np.array(keep, bool)]
                if not texts:
                    continue
                held.append(line_entries(texts, x.h1[at].view(np.int64), edits, rank[at]))
                n += len(held[-1])
                ids, ranks = np.concatenate([seen, x.h1[at]]), np.concatenate([best, rank[at]])
                by = np.lexsort((ranks, ids))
                by = by[np.append(True, ids[by][1:] != ids[by][:-1])]
                seen, best = ids[by], ranks[by]
                if n >= HELD:
                    yield dealt(held)
                    held, n, seen, best = [], 0, seen[:0], best[:0]
        if held:
            yield dealt(held)

    return docs.select("doc_id", "text").mapInArrow(thrifty(task), "block int, entries binary")


def bags_near(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    total = np.zeros(len(a), np.int64)
    for i in range(16):
        d = ((a >> np.uint64(4 * i)) - (b >> np.uint64(4 * i))) & np.uint64(15)
        total += np.minimum(d, np.uint64(16) - d).astype(np.int64)
    return total <= 2 * edits


def meet(blocked: DataFrame, edits: int, few: int = FEW) -> DataFrame:
    """Pairs a, b of distinct lines that share an entry and may be near, a the earlier or of the
    same rank, at most few for each b and key (key null); and all lines a of the keys where some
    had more (key, bag, index), with b = 1 for these.
    """

    def checked(e: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (e["index"][i] | e["index"][j]) == 1
        i, j = i[ok], j[ok]
        ok = bags_near(e["bag"][i], e["bag"][j], edits)
        return i[ok], j[ok]

    def earliest(e: np.ndarray, i: np.ndarray, j: np.ndarray, more: np.ndarray) -> np.ndarray:
        by = np.lexsort((i, j))
        i, j = i[by], j[by]
        start = np.flatnonzero(np.append(True, j[1:] != j[:-1])) if len(j) else j
        over = np.arange(len(j)) - np.repeat(start, np.diff(np.append(start, len(j)))) >= few
        more[j[over]] = True
        same = over & (e["rank"][i] == e["rank"][j])  # either may be the earlier
        more[i[same]] = True
        return np.stack([e["line"][i[~over]], e["line"][j[~over]]])

    def work(e: np.ndarray) -> pa.RecordBatch:
        e = e[np.lexsort((e["line"], e["key"]))]
        first = np.flatnonzero(np.append(True, (e["key"][1:] != e["key"][:-1]) | (e["line"][1:] != e["line"][:-1])))
        index, rank = np.maximum.reduceat(e["index"], first), np.minimum.reduceat(e["rank"], first)
        e = e[first]  # of a line's equal entries one, an index one if any
        e["index"], e["rank"] = index, rank
        again = e["key"][1:] == e["key"][:-1]
        e = e[np.append(again, False) | np.append(False, again)]
        e = e[np.lexsort((e["rank"], e["key"]))]
        start = np.flatnonzero(np.append(True, e["key"][1:] != e["key"][:-1])) if len(e) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(e)))
        found, more = [np.zeros((2, 0), np.int64)], np.zeros(len(e), bool)
        for c in np.unique(count):
            s = start[count == c]
            if c <= WIDE:
                j, i = np.tril_indices(c, -1)
                for k in range(0, len(s), max(1, STEP // len(i))):
                    part = s[k : k + max(1, STEP // len(i)), None]
                    found.append(earliest(e, *checked(e, (part + i).ravel(), (part + j).ravel()), more))
            else:
                rows = max(1, STEP // c)
                for g in s.tolist():
                    for k in range(0, c, rows):
                        j, i = np.meshgrid(np.arange(k, min(c, k + rows)), np.arange(min(c, k + rows)), indexing="ij")
                        ok = j > i
                        found.append(earliest(e, *checked(e, g + i[ok], g + j[ok]), more))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        left = np.repeat(np.logical_or.reduceat(more, start), count) if len(e) else more
        e, more = e[left], more[left]
        none = pa.nulls(len(a), pa.int64())
        columns = [(pa.array(a), pa.array(e["line"])), (pa.array(b), pa.array(more.astype(np.int64))), (none, pa.array(e["key"].view(np.int64))), (none, pa.array(e["bag"].view(np.int64))), (none, pa.array(e["index"].astype(np.int64)))]
        return pa.record_batch([pa.concat_arrays(c) for c in columns], names=["a", "b", "key", "bag", "index"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != now and held:
                    yield work(np.concatenate(held))
                    held = []
                now = block
                held.append(np.frombuffer(data.as_buffer(), dtype=ENTRY))
        if held:
            yield work(np.concatenate(held))

    return blocked.repartition("block").sortWithinPartitions("block").mapInArrow(thrifty(task), "a long, b long, key long, bag long, index long")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """line, text for at least the wanted lines."""
    passes = bit_filter(wanted)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                x = Lines(b.column(0))
                ids, at = np.unique(x.h1.view(np.int64), return_index=True)
                hit = np.flatnonzero(passes(ids)).tolist()
                raw = x.data.tobytes()
                texts = [raw[x.start[at[k]] : x.end[at[k]]].decode() for k in hit]
                yield pa.record_batch([pa.array(ids[hit]), pa.array(texts, pa.string())], names=["line", "text"])

    return docs.select("text").mapInArrow(thrifty(task), "line long, text string").dropDuplicates(["line"])


def within(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Whether each pair of texts is within ``edits`` edits.

    Bit b of vector d, after j letters of the right text, says that its first j letters are
    within d edits of the left text's first j - edits + b letters.
    """
    out = np.zeros(len(left), bool)
    n = np.fromiter(map(len, left), np.int64, len(left))
    m = np.fromiter(map(len, right), np.int64, len(right))
    order = np.argsort(m, kind="stable")
    order = order[np.abs(n - m)[order] <= edits]
    width, at = 2 * edits + 1, 0
    kind = np.min_scalar_type((1 << (width + 1)) - 1)
    full = kind.type((1 << width) - 1)
    while at < len(order):
        longest = int(m[order[at]]) + 64
        k = at
        while k < len(order) and m[order[k]] <= longest and (k - at) * (longest + width) < 1 << 22:
            k += 1
        part = order[at:k]
        at = k
        p = np.full((len(part), longest + 2 * width + 2), -1, np.int64)
        t = np.full((longest + 1, len(part)), -2, np.int64)
        for r, q in enumerate(part.tolist()):
            p[r, edits : edits + n[q]] = np.frombuffer(left[q].encode("utf-32-le"), np.uint32)
            t[: m[q], r] = np.frombuffer(right[q].encode("utf-32-le"), np.uint32)
        p = np.ascontiguousarray(p.T)
        rows, np_, mp = len(part), n[part], m[part]
        state = [np.full(rows, ((1 << (d + 1)) - 1) << edits & int(full), kind) for d in range(edits + 1)]
        for j in range(int(mp.max(initial=0)) + 1):
            done = np.flatnonzero(mp == j)
            if len(done):  # the bit of the whole left text
                bit = (np_[done] - j + edits).astype(kind)
                out[part[done]] = (state[edits][done] >> bit) & kind.type(1) == 1
            if j == int(mp.max()):
                break
            match = np.zeros(rows, kind)
            for b in range(width):
                # letter i - 1 of the left text, i = j + 1 - edits + b, stands at p[i - 1 + edits]
                match |= (p[j + b] == t[j]).astype(kind) << kind.type(b)
            new = [state[0] & match]
            for d in range(1, edits + 1):
                new.append(((state[d] & match) | state[d - 1] | (state[d - 1] >> kind.type(1)) | (new[d - 1] << kind.type(1))) & full)
            # there is no prefix of a negative length
            low = max(0, edits - j - 1)
            if low:
                hide = kind.type(int(full) >> low << low)
                new = [x & hide for x in new]
            state = new
    return out


def near_pairs(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """a, b of the pairs within ``edits`` edits."""
    both = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("line").alias("b"), F.col("text").alias("y")), "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = within(b.column(2).to_pylist(), b.column(3).to_pylist(), edits)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "x", "y").mapInArrow(thrifty(task), "a long, b long")


def near_in_keys(members: DataFrame, places: DataFrame, texts: DataFrame, left: DataFrame, edits: int, size: int = SLICE) -> DataFrame:
    """line: those left that have an earlier line within ``edits`` edits among those of their keys."""
    order = Window.partitionBy("key").orderBy("first", "line")
    slice_no = F.floor((F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")) / size)
    own = members.join(places, "line").join(texts, "line").join(left.withColumn("asks", F.lit(True)), "line", "left")
    own = own.select("key", F.row_number().over(order).alias("at"), slice_no.alias("slice"), "line", "bag", "index", F.coalesce("asks", F.lit(False)).alias("asks"), "text")
    slices = written(own.groupBy("key", "slice").agg(F.array_sort(F.collect_list(F.struct("at", "line", "bag", "index", "asks", "text"))).alias("lines")))
    late = slices.where(F.exists("lines", lambda x: x["asks"])).select("key", F.col("slice").alias("late"), F.filter("lines", lambda x: x["asks"]).alias("x"))
    both = late.join(slices.select("key", "slice", F.col("lines").alias("y")), "key").where("slice <= late").select("x", "y")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (batch.column(k)[r].values for k in (0, 1))
                at, line, bag, index = ([c.field(n).to_numpy() for c in (x, y)] for n in ("at", "line", "bag", "index"))
                text = [c.field("text").to_pylist() for c in (x, y)]
                found = np.zeros(len(x), bool)
                for k in range(0, len(y), WIDE):
                    i, j = (z.ravel() for z in np.meshgrid(np.arange(k, min(k + WIDE, len(y))), np.flatnonzero(~found)))
                    ok = (at[1][i] < at[0][j]) & ((index[1][i] | index[0][j]) == 1)
                    i, j = i[ok], j[ok]
                    ok = bags_near(bag[1][i].view(np.uint64), bag[0][j].view(np.uint64), edits)
                    i, j = i[ok], j[ok]
                    found[j[within([text[1][q] for q in i.tolist()], [text[0][q] for q in j.tolist()], edits)]] = True
                if found.any():
                    yield pa.record_batch([pa.array(line[0][found])], names=["line"])

    return both.mapInArrow(thrifty(task), "line long").distinct()


def removals(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, cls, cut (numbers of the removed lines), n_near of documents that lose lines."""
    keyed = docs.select("doc_id", F.xxhash64("text", F.octet_length("text")).alias("cls"), "text").where("text is not null")
    found = written(occurrences(keyed))
    first = F.min(F.struct("doc_id", "cls", "line")).alias("first")
    lines = written(found.groupBy("h1", "h2").agg(first))
    n_lines, low, high = lines.agg(F.count("*"), F.min("first.doc_id"), F.max("first.doc_id")).first()
    n_blocks = max(BLOCKS, n_lines // BLOCK_LINES)
    met = written(meet(entry_blocks(keyed, edits, min_chars, n_blocks, Order(low, high)), edits))
    places = lines.groupBy(F.col("h1").alias("line")).agg(F.min("first").alias("first"))

    def later_of(pairs: DataFrame) -> DataFrame:
        """line: the later one of each near pair."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
        near = near_pairs(pairs, line_texts(keyed, wanted), edits)
        near = near.join(places.select(F.col("line").alias("a"), F.col("first").alias("fa")), "a").join(places.select(F.col("line").alias("b"), F.col("first").alias("fb")), "b")
        return near.select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("line")).distinct()

    later = written(later_of(met.where("key is null").select("a", "b").distinct()))
    members = met.where("key is not null").select("key", F.col("a").alias("line"), "bag", "index")
    left = written(met.where("key is not null and b = 1").select(F.col("a").alias("line")).distinct().join(later, "line", "left_anti"))
    if not left.isEmpty():
        members = written(members.join(members.join(left, "line").select("key").distinct(), "key", "left_semi"))
        texts = line_texts(keyed, members.select("line").distinct())
        later = later.union(near_in_keys(members, places, texts, left, edits))
    later = later.select(F.col("line").alias("h1")).distinct().withColumn("near", F.lit(True))
    marked = lines.join(later, "h1", "left").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = found.join(marked, ["h1", "h2"]).withColumn("is_first", F.struct("doc_id", "cls", "line").eqNullSafe(F.col("first"))).where("near or not is_first")
    return gone.groupBy("doc_id", "cls").agg(F.array_distinct(F.collect_list("line")).alias("cut"), F.count_distinct(F.when(F.col("is_first"), F.col("line"))).alias("n_near"))


def with_cuts(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """row (a struct of all columns of docs, ``text`` without the removed lines) and n_lines,
    n_removed, n_near (longs: lines with a word, of which removed, of which only near)."""
    cuts = removals(docs, edits, min_chars).select(F.col("doc_id").alias("id"), F.col("cls").alias("own"), "cut", "n_near")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"), F.xxhash64("text", F.octet_length("text")).alias("cls"))
    rows = keyed.join(cuts, F.col("key").eqNullSafe(F.col("id")) & (F.col("cls") == F.col("own")), "left")
    text = F.col("row")["text"]
    kept = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(F.array_contains("cut", i), F.lit(None)).otherwise(x))
    new_text = F.when(F.col("cut").isNull(), text).otherwise(F.array_join(F.filter(kept, lambda x: x.isNotNull()), "\n"))
    with_word = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\f\r"))) > 0))
    own = [F.col("row")[c].alias(c) if c != "text" else new_text.alias("text") for c in docs.columns]
    return rows.select(F.struct(*own).alias("row"), with_word.cast("long").alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with their columns, ``text`` without the removed lines, and n_lines,
    n_removed, n_near in place of own columns of these names."""
    counts = ["n_lines", "n_removed", "n_near"]
    return with_cuts(docs, edits, min_chars).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in counts], *counts)
