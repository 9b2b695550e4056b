"""Repeated passages, fill-in-middle and source divergence, against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import divergence, middle, queries, suffixes

NEW = ["op11_suffix_dedup", "op12_fill_in_middle", "op13_source_divergence"]


@pytest.mark.parametrize("name", NEW)
def test_sql_agrees(spark, name):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found, want = queries.QUERIES[name](spark, folder), con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(want.fetchall()) == Counter(tuple(r) for r in found.select(*columns).collect())


# Repeated passages --------------------------------------------------------------------------------
def brute_spans(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = sorted({j for i in range(len(t) - window + 1) if seen[t[i : i + window]] > 1 for j in range(i, i + window)})
        spans = []
        for j in gone:
            if spans and spans[-1][1] == j:
                spans[-1][1] = j + 1
            else:
                spans.append([j, j + 1])
        out.append([tuple(s) for s in spans])
    return out


def passages(seed, alphabet):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    base = [word(5, 60) for _ in range(6)]
    texts = ["".join(rng.choice(base) if rng.random() < 0.4 else word(1, 30) for _ in range(rng.randint(0, 8))) for _ in range(50)]
    return [*texts, "", "a" * 100, "ab" * 60, texts[0], texts[0], base[0]]


@pytest.mark.parametrize(("window", "per_range", "alphabet"), [(20, 10**6, "abcdefgh é日"), (12, 7, "ab"), (40, 3, "abcdefghijklmnop"), (1, 50, "abcde")])
def test_repeats_against_brute_force(spark, monkeypatch, window, per_range, alphabet):
    """Also with runs and ranges so small that groups go over several ranges and rounds."""
    monkeypatch.setattr(suffixes, "RUN", 40)
    monkeypatch.setattr(suffixes, "FLUSH", 300)
    texts = passages(window, alphabet)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in suffixes.remove_repeats(df, window=window, per_range=per_range).collect()}
    want = brute_spans([t.encode() for t in texts], window)
    for i, t in enumerate(texts):
        assert [(s["start"], s["end"]) for s in rows[i]["spans"]] == want[i], (i, t)
        left = list(t.encode())
        for s, e in reversed(want[i]):
            del left[s:e]
        assert bytes(rows[i]["kept"]) == bytes(left) and rows[i]["n_bytes"] == len(t.encode())


def test_repeats_of_odd_rows(spark, odd, nothing):
    rows = suffixes.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and suffixes.remove_repeats(nothing).count() == 0
    found = {(r["doc_id"], r["n_bytes"]): r for r in rows}
    assert found[0, 0]["spans"] == [] and bytes(found[3, 3]["kept"]) == b"one"
    # The long text stands twice, so nothing of it stays; short repeated rows have no window.
    assert bytes(found[77, found[77, max(n for i, n in found if i == 77)]["n_bytes"]]["kept"]) == b"" and found[5, 23]["spans"] == []


def test_anchors_depend_on_the_window_alone(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abc ") for _ in range(3000)) + b"z" * 700
    window, far = 200, suffixes.reach(200)
    whole = dict(zip(*(x.tolist() for x in suffixes.anchors(text, window)), strict=True))
    for at in [*range(0, len(text) - window, 97), len(text) - window]:
        place, h = suffixes.anchors(text[at : at + window], window)
        assert len(place) == 1 and 0 <= place[0] <= far and whole[at + int(place[0])] == int(h[0])
    monkeypatch.setattr(suffixes, "PIECE", 256)
    assert dict(zip(*(x.tolist() for x in suffixes.anchors(text, window)), strict=True)).items() >= whole.items()


def test_tree_of_losers():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) + b"\0" for _ in range(300)})
    for n in (1, 2, 7):
        runs = [sorted(k for k in keys if rng.random() < 0.5) for _ in range(n)]
        merged = list(suffixes.merge([suffixes._Reader(*suffixes._coded(0, r, {k: (1, 2) for k in r})[1:]) for r in runs if r]))
        assert [m[0] for m in merged] == sorted(k for r in runs for k in r)
        assert all(b[3] == suffixes.shared(a[0], b[0]) for a, b in zip(merged, merged[1:], strict=False))


# Fill-in-middle -----------------------------------------------------------------------------------
def brute_middle(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(tokens), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text, text
    made = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), text, made, text


def test_middle_against_brute_force(spark, odd, nothing, monkeypatch):
    more = [(None, "abc d"), (7, "a<P>b"), (8, "é日本 🎉ab\n\x00c" * 3), (9, "<<S<" * 5), (10, "x" * 300_000 + "é1" * 5), *[(i, "<S" + "ab >" * i) for i in range(20, 60)]]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    made = middle.fill_in_middle(df)
    rows = made.withColumn("back", middle.restore(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r) for r in rows) == Counter(brute_middle(r["doc_id"], r["text"]) for r in df.collect())
    assert middle.fill_in_middle(nothing).count() == 0 and {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_rank_and_select(monkeypatch):
    monkeypatch.setattr(middle, "PIECE", 1024)
    rng = random.Random(4)
    for text in ("", "a", "é", *("".join(rng.choice(["ab", "Z", " ", "é", "日", "\n"]) for _ in range(n)) for n in (5, 700, 3000))):
        found, at, begins = middle.Boundaries(text.encode()), 0, []
        for t in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
            begins.append(at)
            at += len(t.encode())
        assert found.total == len(begins) and [found.select(i) for i in range(len(begins) + 1)] == [*begins, len(text.encode())]


# Source divergence --------------------------------------------------------------------------------
def brute_audit(rows, least, most):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    docs = [(lang or "", source or "", [t.translate(low) for t in term.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        q, p = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        for s, c in counts.items():
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, end in (("pair", pairs, None), ("term", terms, most)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:end], 1):
                    out.append((lang, s, part, item, value, rank))
    return Counter(out)


def test_audit_against_brute_force(spark, odd, nothing, monkeypatch):
    """Also with histograms that must go through values and bytes, texts in pieces, and few terms held at once."""
    for name, value in (("NARROW", 2), ("HELD", 50), ("PIECE", 400)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(8)
    words = ["Aa", "aA", "é", "É", "日本", "x" * 90 + "a", "x" * 90 + "b", "x" * 90, *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]]
    rows = [(" ".join(rng.choices(words, k=rng.choice([0, 3, 20, 200]))) + "1", rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for _ in range(60)]
    rows += [("once upon", "fr", "a"), (None, "fr", "b"), ("!!!", "xx", "z"), *[("tied terms of one count", "tt", "a")] * 3, ("other", "tt", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    for least, most in ((3, 5), (1, 200)):
        assert Counter(tuple(r) for r in divergence.audit(df, least, most).collect()) == brute_audit(rows, least, most)
    plain = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert Counter(tuple(r) for r in divergence.audit(odd).collect()) == brute_audit(plain, 3, 200)
    assert divergence.audit(nothing).count() == 0


def test_shared_bytes(spark):
    pairs = [(b"", b"x"), (b"abc", b"abd"), (b"abc", b"abcd"), (b"a" * 5000 + b"x", b"a" * 5000 + b"y")]
    df = spark.createDataFrame(pairs, "a binary, b binary")
    assert [r[0] for r in df.select(divergence._shared(F.col("a"), F.col("b"))).collect()] == [0, 2, 3, 5000]
    assert np.all(np.array([suffixes.shared(a, b) for a, b in pairs]) == [0, 2, 3, 5000])
