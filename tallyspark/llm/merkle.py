"""A Merkle manifest of a table, built and verified by supersteps over RDDs of run vertices.

Leaves are hashed from their rows by Spark SQL functions, ordered by source and doc_id,
and numbered by place.  From then on everything is messages between vertices.  A vertex is
a run of up to ``ARITY`` consecutive nodes, keyed (tree, level, place); a tree is a source,
by its place among the sources, or ``TOP`` for the tree over the sources' roots.

- Up: the children of a run message it (combined on the sender's side); a run hashes once
  it is complete, which its size or the mark of its level's last node tells, and forwards
  its hash to its own parent.  A run that holds a whole level makes its tree's root.
- Down: the top run sends each child the siblings of that child and what it has itself
  received, until the leaves' runs have the whole path.  There each leaf gets the hash of
  its path, and is folded anew from its row's present text.

Each level's vertices are written to the shared folder, which cuts the lineage.  Vertices
of one level shrink by ``ARITY`` a level, so there are log(rows) supersteps.  A source may hold
any share of the rows: runs are dealt by their whole key.  The driver sees two sources of
each sorted partition, nothing else.

Rows with the same doc_id in one source stand in the order of their leaves; a null doc_id
comes first.  Null columns hash as ``-``.  Repeated rows are leaves of their own.  An empty
table has no rows and no root.  Very long texts are hashed whole, in the JVM.  Columns that
aren't hashed, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import written

ARITY = 16
#: the tree over the sources' roots
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RUN = "tree long, place long, kids array<struct<slot:int,last:boolean,hash:binary,height:int,tree:long>>"
_LEAF_RUN = "tree long, place long, kids array<struct<slot:int,last:boolean,doc_id:long,leaf:binary,now:binary>>"
_PATH = "tree long, place long, height int, subroot binary, path array<struct<slot:int,siblings:binary>>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_hash(**replaced):
    """The hex digest of a row's leaf; replaced: other columns for some fields."""
    cols = [replaced.get(f, F.col(f)).cast("string") for f in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols]).cast("binary"), 256)


def lowered(c):
    return F.translate(c, _CAPITALS, _SMALL)


def _hash(digests: bytes) -> bytes:
    """The digest of the concatenated hex forms of raw digests."""
    return hashlib.sha256(digests.hex().encode()).digest()


def _kept(spark: SparkSession, rows: RDD, schema: str) -> RDD:
    """The rows by way of a table in the shared folder, as plain tuples."""
    return written(spark.createDataFrame(rows, schema, verifySchema=False)).rdd.map(tuple)


def _ends(i: int, rows: Iterator) -> Iterator[tuple]:
    """Of a sorted partition: first source, its rows, last source, its rows, number of sources, whether there are rows."""
    first = last = None
    head = tail = sources = 0
    for source, *_ in rows:
        if not sources or source != last:
            if not sources:
                first = source
            sources, last, tail = sources + 1, source, 0
        tail += 1
        head += sources == 1
    if sources:
        yield i, first, head, last, tail, sources


def _numbered(leaves: DataFrame) -> RDD:
    """((tree, run), (slot, last, doc_id, leaf, now)) of leaves that are sorted over all partitions."""
    rows = leaves.rdd.map(tuple)
    ends = {i: x for i, *x in rows.mapPartitionsWithIndex(_ends).collect()}  # one short row a partition
    start: dict[int, tuple[int, int]] = {}
    after: dict[int, tuple] = {}
    tree, place, was = -1, 0, (None,)
    order = sorted(ends)
    for k, i in enumerate(order):
        first, head, last, tail, sources = ends[i]
        same = was == (first, True)
        start[i] = (tree, place) if same else (tree + 1, 0)
        tree = start[i][0] + sources - 1
        place = start[i][1] + head if sources == 1 else tail
        was = (last, True)
        after[i] = (ends[order[k + 1]][0],) if k + 1 < len(order) else ()

    def number(i: int, rows: Iterator) -> Iterator[tuple]:
        tree, place = start.get(i, (0, 0))
        held = next(rows, None)
        while held is not None:
            coming = next(rows, None)
            following = (coming[0],) if coming is not None else after[i]
            last = following != (held[0],)
            yield (tree, place // ARITY), (place % ARITY, last, held[1], bytes.fromhex(held[2]), bytes.fromhex(held[3]))
            tree, place = (tree + 1, 0) if last else (tree, place + 1)
            held = coming

    return rows.mapPartitionsWithIndex(number)


def _gather(messages: RDD, n: int) -> RDD:
    """Messages of a vertex as one list in the order of their slots, combined before they are sent; at most ARITY each."""

    def join(a: list, b: list) -> list:
        a.extend(b)
        return a

    def add(a: list, x) -> list:
        a.append(x)
        return a

    return messages.combineByKey(lambda x: [x], add, join, n).mapValues(sorted)


def _complete(kids: list) -> bool:
    return len(kids) == ARITY or (kids[-1][1] and len(kids) == kids[-1][0] + 1)


def _forward(key: tuple, kids: list, digest: int, height: int) -> tuple:
    """What a complete run tells: ("root", tree, hash, height) or ("up", (tree, run), message)."""
    tree, place = key
    if not _complete(kids):
        raise ValueError(f"run {key} misses children")
    if place == 0 and kids[-1][1]:  # a whole level
        if len(kids) == 1:
            return "root", tree, kids[0][digest], height
        return "root", tree, _hash(b"".join(k[digest] for k in kids)), height + 1
    return "up", (tree, place // ARITY), (place % ARITY, kids[-1][1], _hash(b"".join(k[digest] for k in kids)), 0, tree)


def _up(spark: SparkSession, runs: RDD, digest: int, n: int) -> tuple[list[RDD], RDD]:
    """Runs of the levels above the given one (lowest first), and (tree, hash, height) of each tree's root."""
    levels, roots, height = [], [], 0
    while True:
        told = runs.map(lambda r, d=digest, h=height: _forward((r[0], r[1]), r[2], d, h))
        roots.append(told.filter(lambda t: t[0] == "root").map(lambda t: t[1:]))
        up = _gather(told.filter(lambda t: t[0] == "up").map(lambda t: t[1:]), n).map(lambda kv: (*kv[0], kv[1]))
        runs = _kept(spark, up, _RUN)
        if runs.isEmpty():
            return levels, spark.sparkContext.union(roots)
        levels.append(runs)
        digest, height = 2, height + 1


def _to_children(joined: tuple) -> Iterator[tuple]:
    """From a run and what it received: the path of each child.  ((tree, place), ((height, subroot, path), kids))."""
    (tree, place), ((height, subroot, path), kids) = joined
    digests = [bytes(k[2]) for k in kids]
    whole = b"".join(digests)
    for slot in range(len(kids)):
        yield (tree, place * ARITY + slot), (height, subroot, [(slot, whole[: 32 * slot] + whole[32 * slot + 32 :]), *path])


def _down(levels: list[RDD], arrivals: RDD, n: int, spark: SparkSession) -> RDD:
    """(tree, run of leaves) -> (height, subroot, path) after the supersteps down; arrivals: the same at (tree, 0) of the root's run."""
    waiting = arrivals.map(lambda a: (a[0], (a[1][0], bytes(a[1][1]), a[1][2])))
    for level in range(len(levels), 0, -1):
        here = waiting.filter(lambda w, h=level: w[1][0] == h + 1)
        runs = levels[level - 1].map(lambda r: ((r[0], r[1]), r[2]))
        sent = here.join(runs, n).flatMap(_to_children).map(lambda w, h=level: (w[0], (h, *w[1][1:])))
        rest = waiting.filter(lambda w, h=level: w[1][0] <= h)
        both = sent.union(rest).map(lambda w: (*w[0], *w[1]))
        waiting = _kept(spark, both, _PATH).map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), [tuple(p) for p in r[4]])))
    return waiting


def _folded(at: bytes, path: list) -> bytes:
    for slot, siblings in path:
        at = _hash(siblings[: 32 * slot] + at + siblings[32 * slot :])
    return at


def manifest(docs: DataFrame, tampered=None) -> DataFrame:
    """doc_id, leaf, subroot, root and proof_sha256 of every row, and folded_root and verified of its present text.

    tampered: a column for the text that is verified, by default the row's own.
    """
    spark = docs.sparkSession
    now = leaf_hash(text=tampered) if tampered is not None else leaf_hash()
    rows = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf_hash().alias("leaf"), now.alias("now"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # numbers depend on the order, so the hashes are written once before they are sorted
    ordered = written(rows).repartitionByRange(n, F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "leaf")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "leaf", "now")
    leaves = _kept(spark, _gather(_numbered(ordered), n).map(lambda kv: (*kv[0], kv[1])), _LEAF_RUN)
    levels, subroots = _up(spark, leaves, 3, n)
    # the sources' roots are the leaves of the top tree, in the order of the sources
    trees = leaves.map(lambda r: r[0]).max() if not leaves.isEmpty() else -1
    top = _gather(subroots.map(lambda r, m=trees: ((TOP, r[0] // ARITY), (r[0] % ARITY, r[0] == m, r[1], r[2], r[0]))), n)
    top = _kept(spark, top.map(lambda kv: (*kv[0], kv[1])), _RUN)
    above, roots = _up(spark, top, 2, n)
    found = roots.collect()  # the one root of the one top tree
    if not found:
        return spark.createDataFrame([], RESULT)
    _, root, height = found[0]
    root = bytes(root)
    began = spark.sparkContext.parallelize([((TOP, 0), (height, root, []))], 1)
    paths = _down(above, began, n, spark)
    tops = top.map(lambda r: ((r[0], r[1]), r[2]))
    # each child of the top tree's lowest runs is a source's root: its height says at which level its run waits
    if height == 0:
        sent = tops.map(lambda t: ((t[1][0][4], 0), (t[1][0][3], bytes(t[1][0][2]), [])))
    else:
        sent = paths.join(tops, n).flatMap(_to_sources)
    arrived = _kept(spark, sent.map(lambda w: (*w[0], *w[1])), _PATH).map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), [tuple(p) for p in r[4]])))
    delivered = _down(levels, arrived, n, spark)

    def results(joined: tuple) -> Iterator[tuple]:
        _, (kids, (height, subroot, path)) = joined
        digests = b"".join(bytes(k[3]) for k in kids)
        for slot, k in enumerate(kids):
            own = [(slot, digests[: 32 * slot] + digests[32 * slot + 32 :]), *path] if height else path
            folded = _folded(bytes(k[4]), own)
            proof = _hash(b"".join(s for _, s in own))
            yield k[2], bytes(k[3]).hex(), subroot.hex(), root.hex(), proof.hex(), folded.hex(), folded == root

    out = leaves.map(lambda r: ((r[0], r[1]), r[2])).join(delivered, n).flatMap(results)
    return spark.createDataFrame(out, RESULT, verifySchema=False)


def _to_sources(joined: tuple) -> Iterator[tuple]:
    _, ((_, _, path), kids) = joined
    digests = [bytes(k[2]) for k in kids]
    for slot, k in enumerate(kids):
        siblings = b"".join(digests[:slot] + digests[slot + 1 :])
        yield (k[4], 0), (k[3], digests[slot], [(slot, siblings), *path])
