import itertools
import random
import subprocess
import sys

from tallyspark.llm import lines as m

SF = "/root/testdata/sf0.001"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b, edits):
    """Banded, for long lines."""
    if abs(len(a) - len(b)) > edits:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    while i < min(len(a), len(b)) and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    return edits > 0 and (near(a[1:], b, edits - 1) or near(a, b[1:], edits - 1) or near(a[1:], b[1:], edits - 1))


def brute(rows, edits, min_chars):
    order = sorted({(d if d is not None else -1 << 63, t) for d, t in rows if t is not None})
    earlier, out = [], {}
    seen = {}
    for d, t in order:
        kept = []
        for x in t.split("\n"):
            if not x.strip(" \t\x0b\f\r"):
                kept.append(x)
                continue
            gone = x in seen or (len(x) >= min_chars and any(len(y) >= min_chars and near(x, y, edits) for y in earlier))
            if x not in seen:
                seen[x] = True
                earlier.append(x)
            if not gone:
                kept.append(x)
        out[(d, t)] = "\n".join(kept)
    return out


def test_within():
    rng = random.Random(1)
    pairs = []
    for _ in range(1500):
        a = [rng.choice("abé漢") for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice([[], ["a"], ["z"]])
        pairs.append(("".join(a), "".join(b)))
    for e in (0, 1, 2, 3, 4):
        got = m.within([a for a, _ in pairs], [b for _, b in pairs], e)
        for (a, b), g in zip(pairs, got):
            assert g == (edit_distance(a, b) <= e) and near(a, b, e) == g, (a, b, e)


def test_entries_meet():
    """Every pair within the edits shares an entry of which one is an index entry."""
    import numpy as np

    rng = random.Random(2)
    for e in (1, 2, 3):
        for _ in range(200):
            a = [rng.choice("abc") for _ in range(rng.randint(2 * e + 2, 20))]
            b = list(a)
            for _ in range(e):
                k = rng.randint(0, len(b))
                b[k : k + rng.randint(0, 1)] = rng.choice([[], ["x"]])
            a, b = "".join(a), "".join(b)
            if a == b or min(len(a), len(b)) <= e:
                continue
            x = m.line_entries([a, b], np.array([1, 2]), e)
            p, q = x[x["line"] == 1], x[x["line"] == 2]
            shared = any(s["key"] == t["key"] and (s["index"] or t["index"]) for s, t in itertools.product(p, q))
            assert shared, (a, b, e)
            assert m.bags_near(p["bag"][:1], q["bag"][:1], e)[0]


def rows_of(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(8, 40))) for _ in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 5)):
            x = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randint(0, len(x))
                x[k : k + rng.randint(0, 1)] = rng.choice([[], ["q"], ["漢"]])
            lines.append("".join(x))
        rows.append((i, rng.choice(["\n", "\n\n", " \n"]).join(lines)))
    return rows + [(3, rows[3][1]), (None, rows[4][1]), (500, None), (501, ""), (502, "\n \n"), (503, "x" * 5000), (504, "x" * 5001)]


def test_dedup_equals_brute_force(spark):
    rows = rows_of(3)
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, cut string").repartition(4)
    both = m.dedup(df.withColumn("o", df["text"]), 2, 10).collect()
    want = brute(rows, 2, 10)
    assert len(both) == len(rows)
    for r in both:
        if r.o is None:
            assert r.text is None and r.n_removed == 0
        else:
            assert r.text == want[(r.doc_id if r.doc_id is not None else -1 << 63, r.o)], r


def test_documents_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, m.EDITS, m.MIN_CHARS)
    got = m.dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "n_near"]
    for r, (d, t) in zip(sorted(got.collect(), key=lambda r: r.doc_id), sorted(rows)):
        assert r.text == want[(d, t)]
    assert m.dedup(docs.limit(0)).count() == 0


def test_large_groups_of_near_lines_give_few_pairs(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(900 - i, base[:30] + "%03d" % i + base[33:]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    met = m.meet(m.entry_blocks(docs, 2, 40, 4, m.Order(601, 900)), 2).where("key is null").select("a", "b").distinct()
    assert met.count() <= 5 * m.FEW * len(rows)
    got = {r.doc_id: r.text for r in m.dedup(docs).collect()}
    want = brute(rows, 2, 40)
    assert got == {d: want[(d, t)] for d, t in rows}


def test_lines_meet_all_candidates_until_one_is_near(spark, monkeypatch):
    """Orders of the same letters agree in counts and in a segment without being near."""
    rng = random.Random(8)
    tail = "".join(rng.choice("abcdefgh") for _ in range(40))
    monkeypatch.setattr(m.near_in_keys, "__defaults__", (1000,))  # several slices a key
    for apart in (False, True):
        heads = ["".join(rng.sample("ijklmnopqrstuvwxyz" * 2, 36)) for _ in range(60)]
        rows = [((1 << 40) * i * apart, h + tail) for i, h in enumerate(heads)]
        rows += [((1 << 40) * 70 * apart, h + "z" + tail[1:]) for h in heads[20:40]] + [(None, heads[50] + tail + "x")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(((r.doc_id if r.doc_id is not None else -1 << 63), r.o, r.text) for r in m.dedup(docs.withColumn("o", docs["text"])).collect())
        order = [(d, t) for d, t in rows]
        seen, want = [], {}
        key = {(r.doc_id, r.text): r.cls for r in docs.selectExpr("doc_id", "text", "xxhash64(text, octet_length(text)) as cls").collect()}
        for d, t in sorted(order, key=lambda x: (x[0] is not None, x[0] or 0, key[x])):
            want[(d if d is not None else -1 << 63, t)] = "" if any(near(t, y, 2) for y in seen) else t
            seen.append(t)
        assert got == sorted((d, t, k) for (d, t), k in want.items())


def test_rows_of_entries_grow_with_the_lines(spark):
    rng = random.Random(9)
    text = lambda: "\n".join("".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(40))
    counts = []
    for n in (300, 1500):
        docs = spark.createDataFrame([(i, text()) for i in range(n)], "doc_id long, text string").coalesce(1)
        blocks = max(m.BLOCKS, n * 40 // m.BLOCK_LINES)
        counts.append(m.entry_blocks(docs, 2, 40, blocks, m.Order(0, n)).count())
    assert counts[1] <= 7 * counts[0] and counts[0] <= 300 * 40


def test_order_of_documents():
    import pyarrow as pa

    for ids in ([0, 1, 5], [-(1 << 63), -5, 0, 7, (1 << 63) - 1], [3]):
        got = m.Order(ids[0], ids[-1])(pa.array([None, *ids], pa.int64())).tolist()
        assert got == sorted(got) and got[0] == 0 < got[1]
    assert m.Order(None, None)(pa.array([None], pa.int64())).tolist() == [0]


def test_a_worker_gives_memory_back():
    """An idle worker stays with its executor, so what a task has used goes at its end."""
    code = """
import random, re
import pyarrow as pa
from tallyspark.llm import lines

def mb():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Frame:
    def select(self, *columns):
        return self
    def mapInArrow(self, task, schema):
        return task

rng = random.Random(4)
words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
texts = ["\\n".join(" ".join(rng.choices(words, k=10)) for _ in range(40)) for _ in range(2000)]
batches = [pa.record_batch([pa.array(range(k, k + 500)), pa.array(texts[k:k + 500])], names=["doc_id", "text"]) for k in range(0, 2000, 500)]
before = mb()
made = sum(b.num_rows for b in lines.entry_blocks(Frame(), 2, 40, 64, lines.Order(0, 2000))(iter(batches)))
print(made, mb() - before)
"""
    made, left = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(made) and float(left) < 100
