"""SimHash against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from graphloom.llm import simhash


def groups(prints):
    """Smallest id by links of 3 bits or fewer, over all pairs."""
    root = {p: p for p in prints.values()}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(root[p], i)
    return {i: least[root[p]] for i, p in prints.items()}


def test_fingerprint():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\n") == 0
    import xxhash

    h = xxhash.xxh64_intdigest
    assert simhash.fingerprint("One  TWO") == h(b"one two", 42) and simhash.fingerprint("É a b") == h("É a b".encode(), 42)
    words = [random.Random(1).choice(["lorem", "ipsum", "dolor", "Sit", "amet"]) + str(i % 7) for i in range(500)]
    hashes = [h(" ".join(words[i : i + 3]).lower().encode(), 42) for i in range(498)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > 498)
    assert simhash.fingerprint(" ".join(words)) == want
    # Pieces of any size give the same.
    for piece in (16, 50, 10_000):
        simhash.PIECE, old = piece, simhash.PIECE
        try:
            assert simhash.fingerprint(" ".join(words)) == want
        finally:
            simhash.PIECE = old


def components(pairs, every):
    root = {p: p for p in every}

    def top(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in every}


def all_close(signed):
    return [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]


@pytest.mark.parametrize("small", [1, 16])
def test_links_by_brute_force(spark, small):
    rng = random.Random(2)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(4):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            prints.add(p)
    # A group around one fingerprint whose members are two to eight bits apart, and one that agrees in its lower half.
    centre = rng.getrandbits(64)
    for i in range(300):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), 1 + i % 4)))
        prints.add((rng.getrandbits(32) << 32) | 12345)
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    found = [(r["a"], r["b"]) for r in simhash.class_links(spark.createDataFrame([(p,) for p in signed], "fp long"), small=small).collect()]
    assert set(found) <= set(all_close(signed))
    assert components(found, signed) == components(all_close(signed), signed)


def test_rows_of_a_close_group_grow_with_the_group(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(62)
    prints = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(62), 3)) for _ in range(3000)}
    links = simhash.class_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    # Every member is three bits from the centre; all pairs would be many more.
    assert links.count() < 10 * len(prints)
    assert set(components([tuple(r) for r in links.collect()], prints).values()) == {min(prints)}


def test_blocks_follow_the_size():
    assert simhash.blocks_for(1000, 3) == 6 and simhash.blocks_for(1 << 33, 3) == 7 and simhash.blocks_for(10**11, 3) > 7
    for mask in simhash.masks(3, 6):
        for other in simhash.finer(mask, 3):
            assert other & mask == mask and len(simhash.finer(mask, 3)) == 20
    assert simhash.finer(-1, 3) == []


def test_marks_never_exceed_the_difference():
    rng = random.Random(7)
    for n in (0, 1, 30, 500, 5000):
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), n - n // 5)) | {rng.getrandbits(64) for _ in range(n // 7)}
        x, y = (simhash.marks(np.array(sorted(s), dtype=np.uint64)) for s in (a, b))
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(a ^ b)


def test_groups_of_documents(spark, small):
    docs = small("documents", "sf0.01")
    rows = simhash.near_duplicates(docs).collect()
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == groups(prints)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).select("doc_id").collect())
    assert kept == sorted(set(groups(prints).values()))


def test_odd_rows(spark, odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and simhash.near_duplicates(nothing).count() == 0
    blank = [r for r in rows if r["fp"] == 0]
    assert {r["doc_id"] for r in blank} == {0, 1, 2, None} and {r["component_id"] for r in blank} == {0}
    assert {r["component_id"] for r in rows if r["doc_id"] in (6, 77)} == {6}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(nothing).count() == 0
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (0, 3, 4, 5, 6, 7, 8, 9)] + [(True, 0)]


def jaccard_groups(texts):
    """Smallest id by links of 5-word Jaccard 0.8 or more, over all pairs of texts."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b) and bool(a and b)
    root = {i: i for i in texts}
    ids = sorted(texts)
    changed = True
    while changed:
        changed = False
        for x, i in enumerate(ids):
            for j in ids[x + 1 :]:
                if root[i] != root[j] and near(sets[i], sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_similar_texts_by_brute_force(spark, odd, nothing):
    rng, texts = random.Random(5), {}
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 9, 40, 150]))]
        for _ in range(6):
            own = list(base)
            for k in rng.sample(range(len(own)), min(len(own), rng.randint(0, 4))):
                own[k] = f"w{rng.randrange(500)}"
            texts[len(texts)] = " ".join(own)
    # 16 and 20 shingles, and 15 of 20: a similarity of just 0.8 links, one of 0.75 doesn't.
    texts |= {100: " ".join(f"x{i}" for i in range(24)), 101: " ".join(f"x{i}" for i in range(20)), 110: " ".join(f"y{i}" for i in range(24)), 111: " ".join(f"y{i}" for i in range(19))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    root = jaccard_groups(texts)
    assert root[101] == 100 and root[111] == 111
    kept = {r["doc_id"] for r in simhash.keep_one_similar(docs).collect()}
    assert kept == set(root.values())
    # Operator 6's rule leaves near copies in.
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} - kept
    assert simhash.keep_one_similar(nothing).count() == 0 and simhash.keep_one_similar(odd).columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.keep_one_similar(odd).collect()) == [(False, i) for i in (0, 3, 4, 5, 6, 7, 8, 9)] + [(True, 0)]


def test_stage_links_similar_texts(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:57]) + " other end here"), (3, "something else")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_stage_compares_fingerprints_first(spark, monkeypatch):
    """Without bands the stage still finds near copies by fingerprints within 3 bits, and by them only; their similarity is still checked."""
    rng, texts = random.Random(8), {}
    for k in range(4):
        base = [f"w{rng.randrange(900)}" for _ in range(400)]
        texts |= {10 * k: " ".join(base), 10 * k + 1: " ".join([*base[:399], "end"]), 10 * k + 2: " ".join(base[:330])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {i: simhash.majority([simhash.shingle_set(t, 5)]) for i, t in texts.items()}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    assert any(near(10 * k, 10 * k + 1) for k in range(4)) and not all(near(10 * k, 10 * k + 2) for k in range(4))
    assert {r["doc_id"] for r in simhash.keep_one_similar(docs).collect()} == {0, 10, 20, 30}
    monkeypatch.setattr(simhash, "bands", lambda hashes: hashes[:0].view("int64"))
    kept = {r["doc_id"] for r in simhash.keep_one_similar(docs).collect()}
    assert all((10 * k + 1 in kept) != near(10 * k, 10 * k + 1) or near(10 * k + 1, 10 * k + 2) for k in range(4)) and len(kept) < len(texts)


def test_no_link_is_lost_where_masks_end_at_different_levels(spark):
    """Many words over the few bits that one mask leaves free, while others can still be cut."""
    count = lambda x: bin(x % (1 << 64)).count("1")
    for blocks in (9, 10):
        free = next(f for m in simhash.masks(3, blocks) for f in simhash.finer(m, 3) if 64 - count(f) <= 9)
        bits = [i for i in range(64) if not free >> i & 1]
        rng = random.Random(blocks)
        base, prints = rng.getrandbits(64), set()
        for w in rng.sample([w for w in range(1 << len(bits)) if count(w) % 2 == 0], 30):
            x = base
            for i, b in enumerate(bits):
                x ^= (w >> i & 1) << b
            prints.add(x - (1 << 64) * (x >> 63))
        prints = sorted(prints)
        root = {x: x for x in prints}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in combinations(prints, 2):
            if count(a ^ b) <= 3:
                root[find(a)] = find(b)
        want = {frozenset(x for x in prints if find(x) == r) for r in {find(x) for x in prints}}
        root.update({x: x for x in prints})
        for r in simhash.class_links(spark.createDataFrame([(x,) for x in prints], "fp long"), blocks=blocks).collect():
            assert count(r["a"] ^ r["b"]) <= 3
            root[find(r["a"])] = find(r["b"])
        assert {frozenset(x for x in prints if find(x) == r) for r in {find(x) for x in prints}} == want


def test_masks_cut_finer_lose_no_pair():
    """For every number of blocks, levels end at nine free bits or fewer, and any three differing bits leave one mask of each level whole."""
    count = lambda x: bin(x % (1 << 64)).count("1")
    rng = random.Random(3)
    for blocks in range(6, 25):
        level = rng.sample(simhash.masks(3, blocks), 3)
        for mask in level:
            chain = [mask]
            while finer := simhash.finer(chain[-1], 3):
                free = [i for i in range(64) if not chain[-1] >> i & 1]
                for _ in range(20):
                    apart = sum(1 << b for b in rng.sample(free, 3))
                    assert any(not f & apart for f in finer)
                assert all(count(f) > count(chain[-1]) for f in finer)
                chain.append(rng.choice(finer))
            assert 64 - count(chain[-1]) <= 9
