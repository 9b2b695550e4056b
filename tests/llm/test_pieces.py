"""SentencePiece scan against the library, and top-k search against all pairs."""

import random

import numpy as np
import pytest

from graphloom.llm import pieces, topk
from graphloom.llm.queries import MODEL_FILE

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    with open(MODEL_FILE, "rb") as f:
        return pieces.Pieces(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)


def chunked(model, text, size):
    full = pieces.SPACE + text.replace(" ", pieces.SPACE)
    starts, rows = list(range(0, max(1, len(full) - model.longest), size)), []
    for no, low in enumerate(starts):
        high = starts[no + 1] if no + 1 < len(starts) else len(full)
        side = max(0, low - model.longest)
        rows.append((full[side : high + model.longest], low - side, high - side, no + 1 == len(starts)))
    matrices = []
    for r in rows:
        own = {}
        for entry, leave in model.transfer(*r):
            own.setdefault(entry, set()).add(leave)
        matrices.append(own)
    states = pieces.border_states(matrices)
    # Products of matrices may be taken in any order.
    left = right = None
    for m in matrices:
        left = m if left is None else pieces.combine(left, m)
    for m in reversed(matrices):
        right = m if right is None else pieces.combine(m, right)
    assert left == right
    return [i for k, r in enumerate(rows) for i in model.backtrace(*r, states[k], states[k + 1])]


def texts(rng):
    plain = " ".join(rng.choice(["über", "thing", "ation", "étés", "running", "the", "of"]) * rng.randint(1, 2) for _ in range(150))
    return [plain, plain.replace(" ", ""), plain.replace(" ", "   "), "".join(rng.choice("ab ▁xyz日本語🎉é=-\n") for _ in range(500)), "=-" * 200 + "a" * 150 + " " * 70 + "b", "x"]


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_library(model, library, seed):
    rng = random.Random(seed)
    for text in texts(rng):
        want = library.encode(text)
        full = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert model.numbers(model.merge(full)) == model.encode(full).tolist() == want
        for size in (64, 100, 257):
            assert chunked(model, text, size) == want
        assert model.decode(want) == library.decode(want)


@pytest.mark.parametrize("wide", [64, 3])
def test_encode_documents(spark, odd, nothing, library, small, monkeypatch, wide):
    # Products of three matrices make a tree of several levels.
    monkeypatch.setattr(pieces, "WIDE", wide)
    for docs, chunk in ((odd, 4096),) if wide == 3 else ((odd, 4096), (small("documents"), 512)):
        found = pieces.encode(docs, MODEL_FILE, chunk=chunk)
        rows = found.collect()
        text = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(rows) == docs.count()
        for r in rows:
            if r["doc_id"] is not None:
                assert r["ids"] == library.encode(text[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"]) and r["exact"]
        back = {r["doc_id"]: r["text"] for r in pieces.decode(found, MODEL_FILE).collect()}
        assert all(back[i] == (t or "") for i, t in text.items() if i is not None)
    assert pieces.encode(nothing, MODEL_FILE).count() == 0


def test_text_with_the_space_mark(spark):
    row = pieces.encode(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"), MODEL_FILE).first()
    assert not row["exact"]


def brute(rows, every, k):
    out = set()
    for qid, q in {(i, v) for i, v in rows if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != qid and len(v) == len(q))
        out |= {(qid, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shard", [40, 10_000])
def test_top_k_by_brute_force(spark, shard):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(0, 300, 2)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(60)]  # ties
    vectors += [(2001, vectors[3][1]), (2001, vectors[3][1]), (2003, [0.5, 0.25])]
    extra = [(5, None), (7, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9, [float("nan")] * 6), (11, [float("inf")] * 6), (None, vectors[0][1])]
    df = spark.createDataFrame(vectors + extra, "vec_id long, embedding array<float>")
    found = topk.top_k(df, every=50, k=5, shard_rows=shard, block_rows=4)
    whole = [(i, tuple(int(np.floor(float(np.float32(x)) * 256)) for x in v)) for i, v in vectors]
    assert {tuple(r) for r in found.collect()} == brute(whole, 50, 5)
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e9, 1e15])
def test_top_k_is_exact_for_large_components(spark, scale):
    """Products pass 2^53 at a scale of 10^6 and 2^63 at 10^9; pairs whose scores differ by a unit are told apart."""
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.normal(size=5) * scale).tolist()) for i in range(0, 120, 2)]
    vectors += [(i + 1, [*v[:4], v[4] + 1 / 256]) for i, v in vectors[:20]]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = topk.top_k(df, every=50, k=5, shard_rows=30, block_rows=2, copy_blocks=1)
    within = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    whole = [(i, tuple(int(np.floor(x * 256)) for x in v)) for i, v in vectors]
    assert {tuple(r) for r in found.collect()} == {(*r[:3], within(r[3])) for r in brute(whole, 50, 5)}


def test_top_k_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [-1.0]), (3, [0.5])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(df).collect()} == {(0, 1, 3, 32768), (0, 2, 50, -65536), (50, 1, 3, -32768), (50, 2, 0, -65536)}
