"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The models at hand are of the BPE kind.  A BPE segmentation is the one path through
the lattice of piece occurrences in which every two neighbours are compatible, that
is, in which the pair's own text is segmented into just that pair.  So edges weigh 0
if compatible and minus infinity if not, and the best path of the (max, +) semiring is
the model's segmentation (a Viterbi over piece scores, as unigram models take it, would
not be).  Paths between two given boundary states are unique for the same reason.

A text is split into chunks of ``CHUNK`` code points.  A chunk's transfer matrix has a
row for each piece that may cover its left border and a column for each that may cover
its right border.  Matrices combine associatively with the max-plus product.  The scan is
parallel: of a text of n chunks, each group of about sqrt(n) neighbouring chunks is multiplied
by a task of its own, the path over the groups' products fixes the piece at each group's
borders, the groups fix those between their chunks side by side, and every chunk is then
traced back on its own.  Only texts longer than a chunk need more than one; those are spread
over the cluster by chunk, no row ever holds more than about sqrt(n) matrices (a few hundred
numbers each), and texts that occur often are encoded once.

Within a chunk, places where no piece can cross (before a space mark, around a line
feed, between two characters that no piece has side by side) cut the lattice into short
parts, whose paths are remembered.

A null text has null ids; an empty one has none; characters the model lacks become its
byte pieces; equal rows give equal rows; an empty table gives no rows; further columns
are ignored.  Decoding is exact but for texts that hold the space mark U+2581 itself,
which reads back as a space.
"""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written
from .textbatch import chunks, thrifty

CHUNK = 32_768
SPACE = "▁"
#: parts that are remembered, half of them in the older generation, and neighbours
KEEP = 1 << 18
#: flags of parts that were met before, a byte each
MET = 1 << 20
#: starts that are remembered
STARTS = 1 << 16
#: characters of a remembered start
NEAR = 5
#: bytes of text that a worker takes at once
SLICE = 2 << 20
State = tuple[int, int]  # start relative to the border (negative), piece
BEGIN: State = (0, -1)


class Vocabulary:
    """The pieces of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str] = []
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            self.text.append(p)
            if m.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                self.byte_of[i] = int(p[1:-1], 16)
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.id[p] = i
                self.score[p] = m.get_score(i)
        self.longest = max(map(len, self.id))

    def decode(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            s = "".join(map(self.text.__getitem__, ids))
        else:
            out, raw = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.text[i])
            out.append(raw.decode("utf-8", "replace"))
            s = "".join(out)
        s = s.replace(SPACE, " ")
        return s[1:] if s.startswith(" ") else s


class Pieces(Vocabulary):
    """The vocabulary and the lattice rules of one model file."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in self.id):
            raise ValueError("a piece crosses a cut; this model isn't supported")
        #: neighbouring characters that some piece has
        self.inside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.fits: dict[int, bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.id = {p: i for p, i in self.id.items() if self.usable(p)}
        #: every start of a piece, with its id or -1
        self.prefixes = {p[:k]: -1 for p in self.id for k in range(1, len(p) + 1)} | self.id
        self.paths: dict[str, tuple[int, ...]] = {}
        #: the generation before; what is met again moves to ``paths``
        self.older: dict[str, tuple[int, ...]] = {}
        self.met, self.n_met = bytearray(MET), 0
        self.begun: dict[str, tuple[tuple[int, int], ...]] = {}
        self.short: dict[str, tuple[tuple[int, int], ...]] = {}
        #: one object for each piece and its length, which all starts share
        self.same: dict[tuple[int, int], tuple[int, int]] = {}

    def merged_from(self, p: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; None for single characters and for pieces
        that merging never makes (BPE by its definition: the best pair first, leftmost on ties)."""
        if p in self.halves:
            return self.halves[p]
        parts, last = list(p), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                last = None
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.halves[p] = last
        return last

    def compatible(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a; -1 is the start of a text or a lone character.

        Merging is run backwards from the pair: the piece that was made later is split into
        its last merge, and a merge across the border that would have come before it (on
        equal scores, one further left) rules the pair out.
        """
        if a < 0 or b < 0:
            return True
        key = a * len(self.text) + b
        fit = self.fits.get(key)
        return self.judged(key, a, b) if fit is None else fit

    def judged(self, key: int, a: int, b: int) -> bool:
        if len(self.fits) >= KEEP:
            self.fits.clear()
        fit = self.fits[key] = self._fit(self.text[a], self.text[b])
        return fit

    def _fit(self, x: str, y: str) -> bool:
        score = self.score
        across = score.get(x + y)
        if across is not None:
            return False
        while True:
            whole_x, whole_y = len(x) == 1, len(y) == 1
            if whole_x and whole_y:
                return True
            if whole_y or (not whole_x and score[x] < score[y]):
                limit = score[x]
                x = self.merged_from(x)[1]
                across = score.get(x + y)
                if across is not None and across > limit:
                    return False
            else:
                limit = score[y]
                y = self.merged_from(y)[0]
                across = score.get(x + y)
                if across is not None and across >= limit:
                    return False

    def usable(self, p: str) -> bool:
        return len(p) == 1 or self.merged_from(p) is not None

    def starting(self, s: str, i: int) -> list[tuple[int, int]]:
        """(piece, end) of the pieces of s at i; -1 for a character the model lacks."""
        out, prefixes = [], self.prefixes
        for k in range(i + 1, min(len(s), i + self.longest) + 1):
            piece = prefixes.get(s[i:k])
            if piece is None:
                break
            if piece >= 0:
                out.append((piece, k))
        if s[i] not in self.id:
            out.append((-1, i + 1))
        return out

    def reach(self, s: str, begin: int, before: int, stop: int) -> dict[int, dict[tuple[int, int], tuple[int, int] | None]]:
        """All nodes of s that compatible paths from ``begin`` (after piece ``before``) meet,
        by end: (start, piece) -> the node before.  Nodes start under ``stop``."""
        ends: dict[int, dict] = {begin: {(begin, before): None}}
        for i in range(begin, stop):
            here = ends.get(i)
            if not here:
                continue
            for piece, k in self.starting(s, i):
                for node in here:
                    if self.compatible(node[1], piece):
                        ends.setdefault(k, {})[(i, piece)] = node
                        break
        return ends

    def trace(self, s: str, ends: dict, begin: int, end: int, node: tuple[int, int]) -> list[int]:
        out: list[int] = []
        while node is not None and end > begin:
            start, piece = node
            out.append(piece if piece >= 0 else -2 - ord(s[start]))
            node, end = ends[end][node], start
        return out[::-1]

    def emit(self, path: list[int], out: list[int]) -> None:
        for p in path:
            if p >= 0:
                out.append(p)
            else:
                out.extend(self.byte[b] for b in chr(-2 - p).encode())

    def starts(self, s: str, at: int) -> tuple[tuple[int, int], ...]:
        """(piece, length) of the pieces of s at a place, longest first.  Those of up to ``NEAR``
        characters are remembered: in ``short`` if no longer piece starts so, in ``begun`` else."""
        near = s[at : at + NEAR]
        out = self.short.get(near)
        if out is not None:
            return out
        out = self.begun.get(near)
        if out is None:
            out = tuple(self.same.setdefault(x, x) for x in self.starting(near, 0)[::-1])
            keep = self.begun if len(near) == NEAR and near in self.prefixes else self.short
            if len(keep) >= STARTS:
                keep.clear()
            keep[near] = out
            if keep is self.short:
                return out
        longer, prefixes = [], self.prefixes
        for k in range(at + NEAR + 1, min(len(s), at + self.longest) + 1):
            piece = prefixes.get(s[at:k])
            if piece is None:
                break
            if piece >= 0:
                longer.append((piece, k - at))
        return (*longer[::-1], *out) if longer else out

    def through(self, s: str) -> list[int]:
        """The one compatible path over s, longest pieces first.  A prefix has one path, so an
        end that was met before needs no second visit."""
        fits, short, starts, size, n = self.fits, self.short, self.starts, len(self.text), len(s)
        met, path, left, at, before = set(), [], [], 0, -1
        options = iter(short.get(s[:NEAR]) or starts(s, 0))
        while True:
            for piece, k in options:
                end = at + k
                if end in met:
                    continue
                if before >= 0 and piece >= 0:
                    key = before * size + piece
                    fit = fits.get(key)
                    if fit is None:
                        fit = self.judged(key, before, piece)
                    if not fit:
                        continue
                met.add(end)
                path.append(piece if piece >= 0 else -2 - ord(s[end - 1]))
                if end == n:
                    return path
                left.append((options, at, before))
                at, before = end, piece
                options = iter(short.get(s[end : end + NEAR]) or starts(s, end))
                break
            else:
                options, at, before = left.pop()
                path.pop()

    def part(self, s: str) -> tuple[int, ...]:
        """Ids of a part between cuts, remembered; it is cut where no piece can cross, a short one
        only before its last character (a mark after a word, mostly)."""
        ids = self.paths.get(s)
        if ids is None:
            ids = self.older.get(s)
            if ids is not None:
                self.remember(s, ids)
        if ids is None:
            known, inside, out, begin, n = self.paths, self.inside, [], 0, len(s)
            for i in range(1 if n > 24 else n - 1 or 1, n):
                if s[i - 1 : i + 1] not in inside:
                    ids = known.get(s[begin:i])
                    out.extend(ids if ids is not None else self.part(s[begin:i]))
                    begin = i
            if begin:
                out.extend(self.part(s[begin:]))
            else:
                path = self.through(s)
                if min(path) < 0:
                    self.emit(path, out)
                else:
                    out = path
            ids = tuple(out)
            if len(s) <= 64 and self.again(s):
                self.remember(s, ids)
        return ids

    def again(self, s: str) -> bool:
        """Whether a part was met before (some others too, by chance): most are met once, and need no memory."""
        at = hash(s) % MET
        if self.met[at]:
            return True
        if self.n_met >= MET // 4:
            self.met, self.n_met = bytearray(MET), 0
        self.met[at] = 1
        self.n_met += 1
        return False

    def remember(self, s: str, ids: tuple[int, ...]) -> None:
        if len(self.paths) >= KEEP // 2:
            self.older, self.paths = self.paths, {}
        self.paths[s] = ids

    def middle(self, s: str, out: list[int]) -> None:
        """Appends the ids of a text that starts and ends at cuts."""
        known = self.paths
        lines = s.split("\n")
        for n, line in enumerate(lines):
            if n:
                out.append(self.byte[10] if "\n" not in self.id else self.id["\n"])
            if not line:
                continue
            if SPACE + SPACE in line:
                parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line)
            else:
                first, *rest = line.split(SPACE)
                parts = [first] if first else []
                parts += [SPACE + w for w in rest]
            for p in parts:
                ids = known.get(p)
                out.extend(ids if ids is not None else self.part(p))

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> list[int]:
        """Ids of a text that is one chunk."""
        out: list[int] = []
        self.middle(self.normal(text), out)
        return out

    # chunks

    def is_cut(self, s: str, i: int) -> bool:
        return 0 < i < len(s) and (s[i] == "\n" or s[i - 1] == "\n" or (s[i] == SPACE and s[i - 1] != SPACE))

    def border_states(self, s: str, b: int) -> list[State]:
        """Pieces of s that start before b and end at it or after."""
        return [(i - b, p) for i in range(max(0, b - self.longest), b) for p, k in self.starting(s, i) if k >= b]

    def end_of(self, s: str, b: int, state: State) -> int:
        start, piece = state
        return b if state == BEGIN else b + start + (len(self.text[piece]) if piece >= 0 else 1)

    def transfer(self, s: str, begin: int, end: int, first: bool, last: bool) -> tuple[list[State], list[State], np.ndarray]:
        """Boundary states of a chunk s[begin:end] (s has its surroundings too) and its matrix."""
        left = [BEGIN] if first else self.border_states(s, begin)
        right = self.border_states(s, end)
        if last:
            right = [y for y in right if self.end_of(s, end, y) == end]
        m = np.full((len(left), len(right)), -np.inf)
        for i, x in enumerate(left):
            p, stop = self.end_of(s, begin, x), end
            if p >= end:  # a short last chunk that one piece covers
                for k, y in enumerate(right):
                    if (begin + x[0], x[1]) == (end + y[0], y[1]):
                        m[i, k] = 0.0
                continue
            q = next((j for j in range(p, end) if self.is_cut(s, j)), None)
            if q is not None:  # the path after a cut is the same for all rows
                if p < q and q not in self.reach(s, p, x[1], q):
                    continue
                done = next((m[h] for h in range(i) if np.isfinite(m[h]).any()), None)
                if done is not None:
                    m[i] = done
                    continue
                z = next(j for j in range(end - 1, q - 1, -1) if self.is_cut(s, j))
                ends = self.reach(s, z, -1, stop)
            else:
                ends = self.reach(s, p, x[1], stop)
            for k, y in enumerate(right):
                if (end + y[0], y[1]) in ends.get(self.end_of(s, end, y), ()):
                    m[i, k] = 0.0
        return left, right, m

    def traced(self, s: str, begin: int, end: int, x: State, y: State) -> list[int]:
        """Ids between border state x (left out) and y (taken)."""
        out: list[int] = []
        p, stop, node = self.end_of(s, begin, x), self.end_of(s, end, y), (end + y[0], y[1])
        if p >= end:
            return out
        q = next((j for j in range(p, end) if self.is_cut(s, j)), None)
        if q is None:
            self.emit(self.trace(s, self.reach(s, p, x[1], end), p, stop, node), out)
            return out
        z = next(j for j in range(end - 1, q - 1, -1) if self.is_cut(s, j))
        if p < q:
            ends = self.reach(s, p, x[1], q)
            self.emit(self.trace(s, ends, p, q, next(iter(ends[q]))), out)
        self.middle(s[q:z], out)
        self.emit(self.trace(s, self.reach(s, z, -1, end), z, stop, node), out)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """One per worker process; the model file is at the same path on every machine."""
    return Pieces(path)


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, associative."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1, initial=-np.inf)


def border_path(matrices: list[np.ndarray], row: int = 0, column: int | None = None) -> list[int]:
    """Column chosen at each right border, on the best path through all from a row to a column
    (the best one, if none is given)."""
    so_far = [matrices[0][row : row + 1]]
    for m in matrices[1:]:
        so_far.append(product(so_far[-1], m))
    at = int(np.argmax(so_far[-1][0])) if column is None else column
    if not np.isfinite(so_far[-1][0, at]):
        raise ValueError("no path through the lattice")
    out = [at]
    for i in range(len(matrices) - 1, 0, -1):
        out.append(int(np.argmax(so_far[i - 1][0] + matrices[i][:, out[-1]])))
    return out[::-1]


def combined(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of neighbouring matrices."""
    return reduce(product, matrices)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _chunk_rows(texts: DataFrame, chunk: int, halo: int) -> DataFrame:
    """key, chunk number, number of chunks, the chunk with its surroundings and where it starts there."""
    n = F.ceil((F.length("text") + 1) / F.lit(chunk)).cast("int")
    rows = texts.select("key", "text", n.alias("n")).select("key", "n", F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE))).alias("s"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    start = F.greatest(F.col("i") * chunk - halo, F.lit(0))
    return rows.select("key", "i", "n", F.substring("s", start + 1, F.lit(chunk + 2 * halo) - (halo - (F.col("i") * chunk - start))).alias("s"), (F.col("i") * chunk - start).cast("int").alias("at"))


STATES = pa.list_(pa.list_(pa.int32()))
STEP = [("left", STATES), ("right", STATES), ("m", pa.list_(pa.float64()))]
STEP_SQL = "`left` array<array<int>>, `right` array<array<int>>, m array<double>"


def _matrix(step: dict) -> np.ndarray:
    return np.array(step["m"]).reshape(len(step["left"]), len(step["right"]))


def borders_of(steps: DataFrame) -> DataFrame:
    """key, i, x, y: the pieces at both borders of each chunk, from chunks' matrices key, i, g (group),
    left, right, m.  Groups are multiplied, then the path over a text's groups is found, then
    the path inside each group."""
    groups = steps.groupBy("key", "g").agg(F.sort_array(F.collect_list(F.struct("i", "left", "right", "m"))).alias("steps"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            whole = combined([_matrix(x) for x in r["steps"]])
            out = {"key": r["key"], "i": r["g"], "left": r["steps"][0]["left"], "right": r["steps"][-1]["right"], "m": whole.ravel().tolist()}
            yield pa.RecordBatch.from_pylist([out], schema=pa.schema([("key", pa.string()), ("i", pa.int32()), *STEP]))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # over a whole text x and y are null: it starts at its only row and may end at any column
        for r in (r for b in batches for r in b.to_pylist()):
            steps, x, y = r["steps"], r["x"], r["y"]
            row = 0 if x is None else steps[0]["left"].index(x)
            picked = border_path([_matrix(s) for s in steps], row, None if y is None else steps[-1]["right"].index(y))
            right = [s["right"][k] for s, k in zip(steps, picked)]
            out = [{"key": r["key"], "i": s["i"], "x": a, "y": b} for s, a, b in zip(steps, [steps[0]["left"][row], *right], right)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("i", pa.int32()), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32()))]))

    made = "key string, i int, x array<int>, y array<int>"
    none = F.lit(None).cast("array<int>")
    tops = groups.mapInArrow(thrifty(multiply), "key string, i int, " + STEP_SQL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "left", "right", "m"))).alias("steps"))
    ends = tops.select("key", "steps", none.alias("x"), none.alias("y")).mapInArrow(thrifty(trace), made).withColumnRenamed("i", "g")
    return groups.join(ends, ["key", "g"]).select("key", "steps", "x", "y").mapInArrow(thrifty(trace), made)


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, ids, n_chunks."""
    model = model or default_model()
    docs = docs.select("doc_id", "text")
    halo = load(model).longest
    if chunk <= 2 * halo:
        raise ValueError("chunks must be longer than two pieces")
    is_giant = F.coalesce(F.length("text") >= chunk, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in (x for batch in batches for x in chunks(batch, "text", SLICE)):
            gc.disable()  # encoding makes no cycles, and the collector would walk all that is remembered
            try:
                ids = [None if t is None else np.asarray(m.encode(t), dtype=np.int32) for t in b.column(1).to_pylist()]
            finally:
                gc.enable()
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array([1] * len(ids), pa.int32())], names=["doc_id", "text", "ids", "n_chunks"])

    out = "doc_id long, text string, ids array<int>, n_chunks int"
    small = docs.where(~is_giant).mapInArrow(thrifty(whole), out)

    giant = docs.where(is_giant).withColumn("key", F.sha2("text", 256))
    rows = _chunk_rows(giant.dropDuplicates(["key"]), chunk, halo).repartition("key", "i")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in (x for batch in batches for x in chunks(batch, "s", SLICE)):
            out = []
            for r in b.to_pylist():
                left, right, t = m.transfer(r["s"], r["at"], min(len(r["s"]), r["at"] + chunk), r["i"] == 0, r["i"] == r["n"] - 1)
                out.append({"key": r["key"], "i": r["i"], "g": r["i"] // math.isqrt(r["n"]), "left": [list(x) for x in left], "right": [list(x) for x in right], "m": t.ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("i", pa.int32()), ("g", pa.int32()), *STEP]))

    borders = borders_of(written(rows.mapInArrow(thrifty(matrices), "key string, i int, g int, " + STEP_SQL)))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in (x for batch in batches for x in chunks(batch, "s", SLICE)):
            rs = b.to_pylist()
            ids = [m.traced(r["s"], r["at"], min(len(r["s"]), r["at"] + chunk), tuple(r["x"]), tuple(r["y"])) for r in rs]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["key", "i", "ids"])

    traced = rows.join(borders, ["key", "i"]).select("key", "i", "s", "at", "x", "y").mapInArrow(thrifty(back), "key string, i int, ids array<int>")
    encoded = traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("c"))
    encoded = encoded.select("key", F.flatten(F.transform("c", lambda x: x["ids"])).alias("ids"), F.size("c").alias("n_chunks"))
    return small.unionByName(giant.join(encoded, "key").select("doc_id", "text", "ids", "n_chunks"))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds ``decoded`` (null for null ids) to a frame of doc_id, text, ids, n_chunks."""
    model = model or default_model()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load_vocabulary(model)
        for b in (x for batch in batches for x in chunks(batch, "text", SLICE)):
            lists = b.column(2)
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [m.decode(flat[i:j].tolist()) if valid else None for valid, i, j in zip(lists.is_valid().to_pylist(), at, at[1:])]
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], names=["doc_id", "text", "ids", "n_chunks", "decoded"])

    return encoded.select("doc_id", "text", "ids", "n_chunks").mapInArrow(thrifty(task), "doc_id long, text string, ids array<int>, n_chunks int, decoded string")

