import random

import numpy as np
import pytest
import sentencepiece

from tallyspark.llm import pieces

MODEL = pieces.default_model()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(n=400):
    rng = random.Random(5)
    alphabet = ["a", "b", "the", " ", " ", "\n", "é", "ing", "ß", "漢", "🙂", "\t", "un", "believ", "1", "2024", "==", ".", "th"]
    return ["", " ", "a", "\n", "a\nb"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_ids_equal_the_library(lib):
    m = pieces.load(MODEL)
    for t in odd_texts():
        ids = m.encode(t)
        if "  " not in t:
            assert ids == lib.encode(t), t
        assert m.decode(ids) == t


def test_chunks_equal_one_chunk():
    m, rng = pieces.load(MODEL), random.Random(6)
    for t in [*odd_texts(60), "antidisestablishmentarianism" * 20, "x" * 500, "漢字" * 90]:
        s = m.normal(t * 4)
        size = rng.randint(33, 70)
        if len(s) <= size:
            continue
        spans = [(a, min(len(s), a + size)) for a in range(0, len(s), size)]
        steps = [m.transfer(s, a, b, a == 0, b == len(s)) for a, b in spans]
        mats = [x[2] for x in steps]
        picked = pieces.border_path(mats)
        assert all(x[1] == y[0] for x, y in zip(steps, steps[1:]))
        ids, before = [], pieces.BEGIN
        for (a, b), x, k in zip(spans, steps, picked):
            ids += m.traced(s, a, b, before, x[1][k])
            before = x[1][k]
        assert ids == m.encode(t * 4), t
        # associative: any bracketing gives the same matrix
        if len(mats) > 2:
            left = pieces.combined(mats)
            right = pieces.product(mats[0], pieces.combined(mats[1:]))
            assert np.array_equal(left, right)


def test_frames(spark, lib):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, ""), (None, "a b"), (None, "a b")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, ids string")
    got = pieces.decode(pieces.encode(df, chunk=700)).collect()
    assert len(got) == len(rows) and max(r.n_chunks for r in got) > 3
    for r in got:
        assert r.decoded == r.text and (r.ids == lib.encode(r.text) if r.text is not None else r.ids is None)
    assert pieces.encode(df.limit(0)).count() == 0


def test_groups_fix_the_same_borders(spark):
    """A long text of many chunks: borders from groups equal those of one scan over all."""
    m, rng = pieces.load(MODEL), random.Random(8)
    text = "".join(rng.choice(["believ", "ing", " ", "the", "x" * 40, "漢字", "\n", "é"]) for _ in range(900))
    s, size = m.normal(text), 70
    spans = [(a, min(len(s), a + size)) for a in range(0, len(s), size)]
    steps = [m.transfer(s, a, b, a == 0, b == len(s)) for a, b in spans]
    picked = pieces.border_path([x[2] for x in steps])
    want = {i: list(x[1][k]) for i, (x, k) in enumerate(zip(steps, picked))}
    rows = [("k", i, i // 7, [list(x) for x in left], [list(x) for x in right], t.ravel().tolist()) for i, (left, right, t) in enumerate(steps)]
    df = spark.createDataFrame(rows, "key string, i int, g int, " + pieces.STEP_SQL)
    got = {r.i: (list(r.x), list(r.y)) for r in pieces.borders_of(df).collect()}
    assert {i: y for i, (_, y) in got.items()} == want
    assert all(got[i][0] == (got[i - 1][1] if i else list(pieces.BEGIN)) for i in got)


def test_parts_met_once_are_not_remembered():
    m, rng = pieces.Pieces(MODEL), random.Random(8)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(3000)})
    ids = m.encode(" ".join(words))
    kept = sum(pieces.SPACE + w in m.paths for w in words)
    assert kept < len(words) // 10
    assert m.encode(" ".join(words)) == ids and all(pieces.SPACE + w in m.paths for w in words)


def test_neighbours_and_starts_are_bounded(monkeypatch):
    text = " ".join(odd_texts())
    want = pieces.Pieces(MODEL).encode(text)
    monkeypatch.setattr(pieces, "KEEP", 50)
    monkeypatch.setattr(pieces, "STARTS", 20)
    monkeypatch.setattr(pieces, "MET", 64)
    m = pieces.Pieces(MODEL)
    assert m.encode(text) == want == m.encode(text)
    assert len(m.fits) <= 50 and len(m.paths) <= 25 and len(m.short) <= 20 and len(m.begun) <= 20
