"""Benchmark decontamination by greedy string tiling.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Seeds are ``MIN_MATCH``-word
sequences (whole items where those are shorter) that a document shares with a benchmark
item.  For each pair that shares a seed, tiling marks the longest common word sequences
that don't overlap earlier ones, longest first, down to ``MIN_MATCH`` words; sequences
are found by rolling (Karp-Rabin) hashes.  An item leaks into a document when its tiles
cover ``COVERAGE`` of the item's words, in whatever order they stand in the document.

The benchmark is broadcast only if its text is at most ``BROADCAST_CHARS``; a larger one
is joined with the documents on seeds (``_joined_leaks``), with equal results.

Null and empty texts and items match nothing; very long texts are searched whole; ties
between equally long tiles go to the earlier place in the item, then in the document;
equal documents each give their rows; equal items each give theirs; empty tables give no
rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Words, chunks, mix, thrifty

MIN_MATCH = 5
COVERAGE = 0.6
BROADCAST_CHARS = 32 << 20


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of every k neighbours in one sequence of word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + mix(words[i : i + n] + np.uint64(i + 1))
    return mix(h)


def matches(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(length, item place, document place) of all maximal common sequences of k words or more."""
    g, t = gram_hashes(doc, k), gram_hashes(item, k)
    order = np.argsort(t, kind="stable")
    lo, hi = np.searchsorted(t[order], g, "left"), np.searchsorted(t[order], g, "right")
    count = hi - lo
    i = np.repeat(np.arange(len(g)), count)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    if not len(i):
        return []
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(i))) + k - 1
    return list(zip(length.tolist(), j[start].tolist(), i[start].tolist()))


def tile(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (item place, document place, length) of the greedy tiling."""
    k = min(min_match, len(item))
    if k == 0:
        return []
    queue = [(-n, j, i) for n, j, i in matches(doc, item, k)]
    heapq.heapify(queue)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles = []
    while queue:
        n, j, i = heapq.heappop(queue)
        taken = in_doc[i : i - n] | in_item[j : j - n]
        if not taken.any():
            in_doc[i : i - n] = in_item[j : j - n] = True
            tiles.append((j, i, -n))
            continue
        # what is left of it waits for its turn at its own length
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= k:
                heapq.heappush(queue, (a - b, j + a, i + a))
    return tiles


def covered(tiles: list[tuple[int, int, int]]) -> int:
    return sum(n for _, _, n in tiles)


class Items:
    """A benchmark's items as word hashes, and their seeds by length."""

    def __init__(self, ids: list, texts: list[str | None], min_match: int) -> None:
        w = Words(pa.array(texts, pa.large_string()), lower=True)
        self.ids, self.words = ids, [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.min_match = min_match
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({min(min_match, len(x)) for x in self.words} - {0}):
            own = [(gram_hashes(x, k), n) for n, x in enumerate(self.words) if min(min_match, len(x)) == k]
            h = np.concatenate([g for g, _ in own])
            owner = np.concatenate([np.full(len(g), n) for g, n in own])
            order = np.argsort(h, kind="stable")
            self.seeds[k] = (h[order], owner[order])

    def pairs(self, w: Words) -> list[tuple[int, int]]:
        """(document, item) of the batch that share a seed."""
        out: set[tuple[int, int]] = set()
        n = w.counts()
        doc = np.repeat(np.arange(len(n)), n)
        for k, (h, owner) in self.seeds.items():
            g = gram_hashes(w.hash, k)
            at = np.searchsorted(h, g)
            at[at == len(h)] = 0
            hit = np.flatnonzero((h[at] == g) & (doc[: len(g)] == doc[k - 1 :]))
            for d, a in {*zip(doc[hit].tolist(), at[hit].tolist())}:
                b = a
                while b < len(h) and h[b] == h[a]:
                    out.add((d, int(owner[b])))
                    b += 1
        return sorted(out)


LEAKS = "doc_id long, item_id long, n_matched long, n_item_words long, n_tiles long, coverage double"


def _collected(benchmark: DataFrame, min_match: int) -> Items | None:
    """The benchmark's items if its size is within the bound."""
    items = benchmark.select("item_id", "text")
    if (items.agg(F.sum(F.length("text") + 16)).first()[0] or 0) > BROADCAST_CHARS:
        return None
    rows = items.collect()
    rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text or ""))
    return Items([r.item_id for r in rows], [r.text for r in rows], min_match)


def _leaks_of(w: Words, d: int, item: np.ndarray, k: int, threshold: float):
    tiles = tile(w.hash[w.first[d] : w.first[d + 1]], item, k)
    n = covered(tiles)
    return (n, len(tiles)) if n and n >= threshold * len(item) else None


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = COVERAGE) -> DataFrame:
    """A row for each leak of an item into a document."""
    docs = docs.select("doc_id", "text")
    found = _collected(benchmark, min_match)
    if found is None:
        return _joined_leaks(docs, benchmark, min_match, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for b in chunks(batch, "text"):
                w, ids, out = Words(b.column(1), lower=True), b.column(0).to_pylist(), []
                for d, n in items.pairs(w):
                    if hit := _leaks_of(w, d, items.words[n], min_match, threshold):
                        size = len(items.words[n])
                        out.append((ids[d], items.ids[n], hit[0], size, hit[1], hit[0] / size))
                yield _leak_batch(out)

    return docs.mapInArrow(thrifty(task), LEAKS)


def _leak_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.float64()]
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "n_matched", "n_item_words", "n_tiles", "coverage"])


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = COVERAGE) -> DataFrame:
    """The documents, with all of their columns, into which no item leaks."""
    found = _collected(benchmark, min_match)
    if found is None:
        bad = _joined_leaks(docs.select("doc_id", "text"), benchmark, min_match, threshold, keep_key=True).select("__key").distinct()
        return docs.join(bad, F.sha2(docs["text"], 256) == bad["__key"], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for b in chunks(batch, "text"):
                w = Words(b.column(b.schema.get_field_index("text")), lower=True)
                keep = np.ones(b.num_rows, bool)
                for d, n in items.pairs(w):
                    if keep[d] and _leaks_of(w, d, items.words[n], min_match, threshold):
                        keep[d] = False
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(thrifty(task), docs.schema)


def _seed_rows(texts: DataFrame, key: str, sizes: list[int] | None, min_match: int) -> DataFrame:
    """key, seed of every text; of a benchmark item (sizes None) at its own seed length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                w, keys = Words(b.column(1), lower=True), b.column(0)
                for d in range(b.num_rows):
                    x = w.hash[w.first[d] : w.first[d + 1]]
                    for k in sizes or ([min(min_match, len(x))] if len(x) else []):
                        g = np.unique(gram_hashes(x, k)) ^ np.uint64(k)
                        yield pa.record_batch([pa.array([keys[d].as_py()] * len(g), keys.type), pa.array(g.view(np.int64))], names=["key", "seed"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, "text").mapInArrow(thrifty(task), f"key {kind}, seed long")


def _joined_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int, threshold: float, keep_key: bool = False) -> DataFrame:
    """Leaks for a benchmark of any size: pairs by a join on seeds, then tiling of each pair."""
    keyed = docs.withColumn("__key", F.sha2("text", 256)).where("text is not null")
    texts = keyed.select("__key", "text").dropDuplicates(["__key"])
    items = benchmark.select("item_id", "text").where("text is not null").withColumn("__item", F.sha2("text", 256))
    item_texts = items.select("__item", "text").dropDuplicates(["__item"])
    mine = _seed_rows(item_texts, "__item", None, min_match).withColumnRenamed("key", "__item")
    theirs = _seed_rows(texts, "__key", list(range(1, min_match + 1)), min_match).withColumnRenamed("key", "__key")
    pairs = theirs.join(mine, "seed").select("__key", "__item").distinct()
    both = pairs.join(texts, "__key").join(item_texts.withColumnRenamed("text", "item"), "__item").select("__key", "__item", "text", "item")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                w, t, out = Words(b.column(2), lower=True), Words(b.column(3), lower=True), []
                for d in range(b.num_rows):
                    item = t.hash[t.first[d] : t.first[d + 1]]
                    if hit := _leaks_of(w, d, item, min_match, threshold):
                        out.append({"__key": b.column(0)[d].as_py(), "__item": b.column(1)[d].as_py(), "n_matched": hit[0], "n_item_words": len(item), "n_tiles": hit[1], "coverage": hit[0] / len(item)})
                if out:
                    yield pa.RecordBatch.from_pylist(out)

    found = both.mapInArrow(thrifty(task), "__key string, __item string, n_matched long, n_item_words long, n_tiles long, coverage double")
    if keep_key:
        return found
    rows = found.join(items.select("__item", "item_id"), "__item").join(keyed.select("__key", "doc_id"), "__key")
    return rows.select("doc_id", "item_id", "n_matched", "n_item_words", "n_tiles", "coverage")
