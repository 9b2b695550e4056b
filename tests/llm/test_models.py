"""Toxicity, language and quality: held-out accuracy and odd rows; trees and calibration by themselves."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import language_id, quality, toxicity
from graphloom.llm.trees import BoostedTrees, Isotonic


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = BoostedTrees(rounds=80).fit(x[:1500], y[:1500])
    assert ((trees.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    curve = Isotonic().fit(trees.margin(x[:1500]), y[:1500])
    grid = curve(np.linspace(-9, 9, 200))
    assert (np.diff(grid) >= 0).all() and grid.min() >= 0 and grid.max() <= 1
    assert BoostedTrees(prior=0.1).fit(x[:0], y[:0]).margin(x[:1])[0] == pytest.approx(math.log(1 / 9))


def parts(rows, mod, part):
    return {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % mod == part for r in rows}


def test_toxicity_on_the_held_out_part(spark, small):
    docs, labels = small("documents", "sf0.1"), small("labels", "sf0.1")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows} == parts(rows, 5, 0)
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    test = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    hits, wrong = sum(p and t for p, t in test), sum(p and not t for p, t in test)
    assert hits >= 0.85 * sum(t for _, t in test) and wrong <= 0.01 * len(test)


def test_toxicity_of_odd_rows(spark, odd, nothing, marks):
    rows = toxicity.toxicity(odd, marks).collect()
    assert len(rows) == odd.count() and toxicity.toxicity(nothing, marks).count() == 0
    plain = toxicity.toxicity(odd, marks.limit(0)).collect()
    assert all(r["score"] == pytest.approx(0.1) for r in plain) and not any(r["held_out"] for r in plain if r["doc_id"] is None)
    kept = toxicity.keep_civil(odd, marks.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_disguised_and_inflected_words():
    lexicon = {"scoun": 4.0}
    look = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, lexicon, frozenset({"sco"})), strict=True))
    assert look("Scoundrelry!")["hits"] == look('a "scounz" b')["hits"] == 1 and look("scone")["hits"] == 0
    assert look("sc0undrel")["disguised_hits"] == 1 and look("you big scoundrel")["near_second_person"] > 0


def test_language_models_tell_their_words_apart():
    texts = {"aa": ["abab", "abba", "cab"], "bb": ["xyz", "zzy"]}
    counts = {}
    for lang, words in texts.items():
        grams = [language_id.padded(w, 3)[i : i + 3] for w in words for i in range(len(w) + 1)]
        counts[lang] = (sorted(set(grams)), [grams.count(g) for g in sorted(set(grams))])
    m = language_id.CharModels(["aa", "bb"], 3).fit(counts)
    assert all(np.isfinite(m.words([w])[0]).all() and (m.words([w])[0][:2] < 0).all() for w in ("a", "ab", "zq"))
    assert m.words(["abab"])[0][0] > m.words(["abab"])[0][1] and m.words(["zyx"])[0][1] > m.words(["zyx"])[0][0]
    assert m.words(["ab"])[0][2] == 3


def test_language_probability_by_hand():
    """Bigrams of one word type, with the formula written out."""
    m = language_id.CharModels(["l"], 2).fit({"l": (["\x02a", "ab", "b\x03"], [3, 2, 2])})
    # Lower order: each of a, b and the end follows one symbol kind; all counts are 1, so the discount is 1 and all goes to the uniform part.
    low = 1 / 4
    # Highest order: counts 3, 2, 2, none once, so the discount is one half.
    p = [(3 - 0.5) / 3 + 0.5 / 3 * low, (2 - 0.5) / 2 + 0.5 / 2 * low, (2 - 0.5) / 2 + 0.5 / 2 * low]
    assert m.words(["ab"])[0][0] == pytest.approx(sum(map(math.log, p)))


def test_language_on_the_held_out_part(spark, small):
    docs = small("documents", "sf0.01")
    rows = language_id.identify(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    test = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert {r["doc_id"]: r["held_out"] for r in rows} == parts(rows, 4, 2)
    assert np.mean(test) >= 0.98 and all(0 <= r["score"] <= 1 for r in rows) and len(rows) == len(lang)


def test_language_of_odd_rows(spark, odd, nothing):
    rows = language_id.identify(odd).collect()
    assert len(rows) == odd.count() and language_id.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, 9)} == {"und"}
    assert {r["lang_pred"] for r in rows if r["doc_id"] == 6} <= {"en", "de", "und"}
    blind = language_id.identify(odd.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in blind} == {("und", 0.0)}


def test_quality_on_the_held_out_part(spark, small):
    docs, labels = small("documents", "sf0.1"), small("labels", "sf0.1")
    rows = quality.quality(docs, labels).collect()
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    test = [(r["predicted"], good[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in good]
    assert len(rows) == docs.count() and np.mean([p == g for p, g in test]) >= 0.97
    assert all(0 <= r[c] <= 1 for r in rows for c in ("score", "document_score", "host_posterior", "path_posterior"))


def test_sites_speak_for_their_documents(spark):
    """Equal texts: a site whose labelled documents are bad pulls its unlabelled ones down, a sparse site hardly."""
    rows = [(i, "the same words here", "en", "bad" if i < 60 else "good" if i < 120 else "sparse") for i in range(122)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    learn = [i for i in range(121) if zlib.crc32(str(i).encode()) % 5 and i % 3]
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in learn], "doc_id long, quality int")
    score = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    assert score[0] < 0.45 < 0.55 < score[60] and score[0] < score[121] < score[60]


def test_quality_of_odd_rows(spark, odd, nothing, marks):
    rows = quality.quality(odd, marks).collect()
    assert len(rows) == odd.count() and all(0 < r["score"] < 1 for r in rows)
    assert quality.quality(nothing, marks).count() == 0
    assert all(r["score"] == pytest.approx(0.5) for r in quality.quality(odd, marks.limit(0)).collect())


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35, min(35, x))))


def walk(trees, x):
    """A tree's margin, node by node."""
    out = trees.base
    for fs, cs, leaves in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        node = 0
        while node < len(fs):
            node = 2 * node + (2 if x[fs[node]] > cs[node] else 1)
        out += leaves[node - len(fs)]
    return out


def learnable(labels, name):
    best = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r[name] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            best[r["doc_id"]] = max(r[name], best.get(r["doc_id"], 0))
    return best


def test_toxicity_by_brute_force(spark, small):
    docs, labels = small("documents", "sf0.1"), small("labels", "sf0.1")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    learn = {i: y for i, y in learnable(labels, "toxic").items() if i in text}
    assert len(learn) <= 20_000
    model = toxicity.fit(docs, labels)
    # The lexicon from plain counts.
    seen, bad, n, toxic = Counter(), Counter(), 0, 0
    for i, y in learn.items():
        if zlib.crc32(str(i).encode()) % 5 != 4:
            words = {w.strip(toxicity.EDGE) for w in text[i].lower().split()}
            terms = {b for w in words if w and not w[0].isdigit() for b in ([w[:k] for k in (3, 4, 5, 6, 8) if len(w) >= k] or [w])}
            seen.update(terms)
            bad.update(terms if y else ())
            n, toxic = n + 1, toxic + y
    rate = toxic / n
    odds = {t: math.log((bad[t] + 0.5) / (seen[t] - bad[t] + 0.5)) - math.log(rate / (1 - rate)) for t in bad if bad[t] >= 4}
    sure = {t: o for t, o in odds.items() if o >= 2 and (bad[t] - seen[t] * rate) / math.sqrt(seen[t] * rate * (1 - rate) + 1) >= 5}
    assert len(sure) < 2_000 and sure.keys() == model.lexicon.keys()
    assert all(model.lexicon[t] == pytest.approx(o) for t, o in sure.items())
    # Scores from a walk through each tree and the calibration curve's two neighbours.
    for r in toxicity.toxicity(docs, labels).where("doc_id % 40 = 0").collect():
        margin = walk(model.trees, toxicity.features(text[r["doc_id"]], sure, frozenset(t[:3] for t in sure)))
        at, value = model.curve.at, model.curve.value
        j = sum(a <= margin for a in at)
        want = value[0] if j == 0 else value[-1] if j == len(at) else value[j - 1] + (value[j] - value[j - 1]) * (margin - at[j - 1]) / (at[j] - at[j - 1])
        assert r["score"] == pytest.approx(min(max(want, 0), 1), abs=1e-9)


def test_language_by_brute_force(spark, small):
    """Interpolated Kneser-Ney from dictionaries of strings, the formula term by term."""
    docs, order = small("documents", "sf0.001"), 5
    rows = docs.collect()
    crc = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in rows}
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    outside = Counter(r["lang"] for r in rows if crc[r["doc_id"]] < 2)
    counts = defaultdict(Counter)
    for r in rows:
        if crc[r["doc_id"]] < 2 or crc[r["doc_id"]] == 3 and outside[r["lang"]] < 20:
            for w in words(r["text"]):
                w = "\x02" * (order - 1) + w + "\x03"
                counts[r["lang"]].update(w[i : i + order] for i in range(len(w) - order + 1))
    levels = {}
    for lang, top in counts.items():
        own = [None] * order
        own[order - 1] = top
        for k in reversed(range(order - 1)):
            own[k] = Counter(g[1:] for g in own[k + 1])
        levels[lang] = []
        for c in own:
            once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            total, kinds = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            levels[lang].append((c, total, kinds, once / (once + 2 * twice) if once else 0.5))
    letters = len({g for own in levels.values() for g in own[0][0]})

    def log_p(lang, gram):
        p = 1 / (letters + 1)
        for k, (c, total, kinds, discount) in enumerate(levels[lang]):
            g = gram[len(gram) - k - 1 :]
            if total[g[:-1]]:
                p = max(c[g] - discount, 0) / total[g[:-1]] + max(discount * kinds[g[:-1]] / total[g[:-1]], 1e-9) * p
        return math.log(p)

    found, languages = language_id.fit(docs), sorted(levels)
    assert found.models.languages == languages
    answers = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    for r in rows[::9]:
        grams = [g for w in words(r["text"][:3000]) for p in ["\x02" * 4 + w + "\x03"] for g in (p[i : i + order] for i in range(len(w) + 1))]
        if grams:
            want = [-sum(log_p(lang, g) for g in grams) / len(grams) for lang in languages]
            x = found.entropies([r["text"][:3000]])[0]
            assert x[:-1] == pytest.approx(want) and x[-1] == len(grams)
            if len(r["text"]) <= 3000:
                share = [math.exp(-(e - min(want)) * found.temperature) for e in want]
                assert answers[r["doc_id"]]["lang_pred"] == languages[int(np.argmin(want))]
                assert answers[r["doc_id"]]["score"] == pytest.approx(max(share) / sum(share))


def test_rare_languages_learn_from_the_calibration_part(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 3]
    rows = [(str(i), "the house is on the hill and the road is long " * 3, "en") for i in range(200)] + [(str(i), "zzyx qwvk xxyz kvwq " * 5, "xx") for i in ids[-3:]]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()} == {i: lang for i, _, lang in rows}


def plain_quality(docs, labels, host, path, margins):
    """Posteriors and scores with loops over documents and sites."""
    learn = learnable(labels, "quality")
    rows = [(r["doc_id"], r[host], r[path]) for r in docs.collect()]
    good = {i: learn.get(i, sigmoid(margins[i])) for i, _, _ in rows}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, h, p in rows:
        hosts[h].append(good[i])
        paths[h, p].append(good[i])
    clip = lambda x, e: min(max(x, e), 1 - e)
    mean = clip(sum(good.values()) / len(good), 1e-4)

    def strength(groups, priors):
        n = [len(g) for g in groups]
        draw = sum(len(g) * m * (1 - m) for g, m in zip(groups, priors, strict=True)) / sum(n)
        between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, priors, strict=True))
        room = max(sum(n) - sum(x * x for x in n) / sum(n), 1e-9)
        own = max((between - (len(n) - 1) * draw) / room, 0)
        return min(max(draw / max(own, 1e-12) - 1, 1), 1e4)

    hs = strength(list(hosts.values()), [mean] * len(hosts))
    of = {h: clip(sum(g) / len(g), 1e-4) for h, g in hosts.items()}
    ps = strength(list(paths.values()), [of[h] for h, _ in paths])
    odds = lambda x: math.log(clip(x, 1e-6) / (1 - clip(x, 1e-6)))
    out = {}
    for i, h, p in rows:
        up = (sum(hosts[h]) - good[i] + hs * mean) / (len(hosts[h]) - 1 + hs)
        own = (sum(paths[h, p]) - good[i] + ps * up) / (len(paths[h, p]) - 1 + ps)
        out[i] = (up, own, 1 / (1 + math.exp(-(margins[i] + odds(own) - odds(mean)))))
    return out


def test_quality_by_brute_force(spark, small):
    docs, labels = small("documents", "sf0.01"), small("labels", "sf0.01")
    model = quality.fit(docs, labels)
    margins = {r["doc_id"]: walk(model, quality.features(r["text"])) for r in docs.collect()}
    want = plain_quality(docs, labels, "source", "lang", margins)
    for r in quality.quality(docs, labels).collect():
        assert (r["host_posterior"], r["path_posterior"], r["score"]) == pytest.approx(want[r["doc_id"]], rel=1e-9)


def test_hosts_and_paths_of_addresses(spark):
    urls = ["https://user@Example.org:8080/a/b?x=1", "http://example.org/a", "//example.org/b", "nothing", None, "https://other.example"]
    docs = spark.createDataFrame([(i, "some text", u, f"h{i % 2}") for i, u in enumerate(urls)], "doc_id long, text string, url string, shop string")
    host, path = quality.site(docs)
    assert [tuple(r) for r in docs.select(host, path).collect()] == [("example.org", "/a"), ("example.org", "/a"), (None, "/b"), (None, ""), (None, None), ("other.example", "")]
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert quality.quality(docs, labels).count() == 6
    own = quality.quality(docs, labels, host=docs["shop"], path=docs["url"])
    assert own.count() == 6
