"""Toxicity, quality and licences: held-out accuracy, brute force over small tables, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairedsense.llm import licences, quality, text as T, toxicity
from .helpers import documents, odd_rows, words

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=900):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        toxic, bad = i % 8 == 0, i % 7 == 0
        w = words(rng, rng.randrange(5, 120), 800).split()
        if toxic:
            for _ in range(1 + len(w) // 20):
                w.insert(rng.randrange(len(w)), rng.choice(["grobian", "lump", "tropf"]))
        if bad:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or toxic:
            labels.append((i, int(not bad), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (10**9, 1, 1)], LABELS)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    out = toxicity.toxicity(docs, labels).toPandas()
    import zlib

    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = out[out.held_out]
    truth = held.doc_id % 8 == 0
    assert held[truth].predicted.mean() > 0.95 and held[~truth].predicted.mean() < 0.02
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.7)).all()
    # labels of held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(docs, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again, out.set_index("doc_id").score.reindex(again.index))


def test_toxicity_of_odd_rows(spark):
    docs, labels = corpus(spark, 200)
    odd = docs.withColumn("evidence", F.lit("x")).select(*docs.columns)
    mixed = odd.union(documents(spark, [(r[0] and r[0] + 10_000, r[1]) for r in odd_rows()]))
    out = toxicity.toxicity(mixed, labels).filter("doc_id is null or doc_id > 9999").collect()
    assert len(out) == 8 and all(0 <= r["score"] <= 1 for r in out)
    empty = {r["score"] for r in out if r["doc_id"] in (10_001, 10_002, 10_003)}
    assert len(empty) == 1 and not [r for r in out if r["doc_id"] is None][0]["held_out"]
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(documents(spark, []), none).count() == 0
    repeated = toxicity.toxicity(docs.limit(5).union(docs.limit(5)), labels)
    assert repeated.count() == 10 and repeated.distinct().count() == 5


def brute_kneser_ney(texts, df_of, documents_in_all):
    """log P(word | context) per side, from the definitions, over whole words."""
    fit = {}
    for text, toxic in texts:
        fit.setdefault(text, []).append(toxic)
    grams = {c: Counter() for c in "to"}
    for text, votes in fit.items():
        w = ["<s>", *re.findall(r"[0-9a-z]+", text.lower())]
        grams["t" if sum(votes) * 2 > len(votes) else "o"].update(set(zip(w, w[1:])))
    vocabulary = {w for g in grams.values() for pair in g for w in pair}
    more = toxicity.PRIOR * max(1, documents_in_all / len(fit))
    others = len(set(df_of) - vocabulary) + 1
    raw = {w: df_of.get(w, 0) + more for w in vocabulary}
    rest = sum(n for w, n in df_of.items() if w not in vocabulary) + more * others
    mass = sum(raw.values()) + rest

    def side(c, lowered):
        rate = lambda counts: max(list(counts).count(1), 1) / (max(list(counts).count(1), 1) + 2 * list(counts).count(2))
        g = grams[c]
        types, total = Counter(w for _, w in g), Counter()
        for (v, _), n in g.items():
            total[v] += n
        low, high = rate(types.values()) + lowered, rate(g.values()) + lowered
        heard = {w: max(n - low, 0) for w, n in types.items()}
        spare = 1 - sum(heard.values()) / max(sum(types.values()), 1)

        def word(w):
            return heard.get(w, 0) / max(sum(types.values()), 1) + spare * raw.get(w, rest) / mass

        def p(v, w):
            left = sum(max(n - high, 0) for (x, _), n in g.items() if x == v)
            stays = total[v] + toxicity.STRENGTH
            return max(g[v, w] - high, 0) / stays + (1 - left / stays) * word(w)

        return p, word

    return {"t": side("t", 0), "o": side("o", 0), "peak": side("t", 1)}


def test_toxicity_against_brute_force(spark):
    rng = random.Random(8)
    fitted = [(words(rng, rng.randrange(0, 9), 12), rng.randrange(2)) for _ in range(60)]
    fitted += fitted[:9] + [(fitted[0][0], 1)] * 3
    every = [t for t, _ in fitted] + [words(rng, 12, 30) for _ in range(40)]
    df_of = Counter(w for t in every for w in set(t.split()))
    docs = documents(spark, list(enumerate(every)))
    labelled = spark.createDataFrame([(t, y, False) for t, y in fitted], "text string, toxic int, calibrate boolean")
    model = toxicity.fit(docs, labelled)
    sides = brute_kneser_ney(fitted, df_of, len(every))
    tests = [words(rng, n, 35) for n in (1, 3, 8, 40)]
    got = model.evidence(*toxicity.tokens(next(T.slices(pa.array(tests)))))
    for text, row in zip(tests, got):
        w = ["<s>", *text.split()]
        log = {c: [math.log(p(a, b)) for a, b in zip(w, w[1:])] for c, (p, _) in sides.items()}
        alone = [math.log(sides["peak"][1](x)) - math.log(sides["o"][1](x)) for x in w[1:]]
        wanted = [np.mean(np.subtract(log["t"], log["o"])), max(np.subtract(log["peak"], log["o"])), max(alone)]
        assert row == pytest.approx(wanted, abs=1e-5)


def test_toxicity_of_rare_expressions(spark):
    """An insult in three labelled texts, and one fixed phrase of ordinary words in long texts, stand out; a word of one text doesn't."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        w = words(rng, rng.randrange(20, 200), 400).split()
        toxic = i % 6 == 0
        if toxic:
            w[rng.randrange(len(w))] = "schuft" if i < 18 else rng.choice(["grobian", "lump"]) if i % 12 else "w1 w2 w3"
        if i == 6:
            w[3] = "einzeln"
        rows.append((" ".join(w), int(toxic), i % 4 == 1 or i >= 500))
    model = toxicity.fit(documents(spark, list(enumerate(t for t, _, _ in rows))), spark.createDataFrame(rows, "text string, toxic int, calibrate boolean"))
    plain = words(rng, 60, 400)
    long = words(rng, 3000, 400)
    texts = [f"{plain} schuft {plain}", plain, f"{long} w1 w2 w3 {plain}", f"{plain} einzeln {plain}", f"{long} nie gehoert"]
    e = model.evidence(*toxicity.tokens(next(T.slices(pa.array(texts)))))
    assert e[0, 2] > e[1, 2] + 1.5 and e[0, 2] > e[3, 2] + 1
    assert e[2, 1] > e[4, 1] + 0.5
    p = toxicity.probability(e, model.weights)
    assert p[0] > 0.7 and max(p[1], p[3], p[4]) < 0.3


def test_model_distributions_sum_to_one(spark):
    docs, labels = corpus(spark, 300)
    model = toxicity.fit(docs, toxicity.labelled_sample(docs, labels))
    for side in model.sides.values():
        assert side.word.sum() == pytest.approx(1, abs=1e-9)
        assert (side.back > 0).all() and (side.back <= 1).all()
        stays = np.bincount(model.pairs // (len(model.vocabulary) + 1), weights=side.pair, minlength=len(side.back))
        assert np.allclose(stays + side.back, 1, atol=1e-5)


def brute_weights(docs, labels):
    def grams(text):
        piece = next(T.slices(pa.array([text or ""])))
        single, pair, _ = quality.features(piece)
        return single.tolist() + [p for p in pair.tolist() if p >= 0]

    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    rows = docs.collect()
    for r in rows:
        for b in grams(r["text"]):
            raw[b] += 1
            target[b] += r["doc_id"] in good
    w = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return {r["doc_id"]: sum(w[b] for b in grams(r["text"])) for r in rows}


def test_quality_against_brute_force(spark):
    docs, labels = corpus(spark)
    out = quality.select(docs, labels).toPandas().set_index("doc_id")
    want = brute_weights(docs, labels)
    assert np.allclose(out.__log_weight, [want[i] for i in out.index])
    known = [r for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None]
    k = round(sum(r["quality"] for r in known) / len(known) * len(out))
    assert set(out.index[out.__selected]) == set(out.__key.nlargest(k).index)
    good = out.index % 7 != 0
    assert out[good].__selected.mean() > 0.97 and out[~good].__selected.mean() < 0.1


def test_quality_of_odd_rows(spark):
    docs, labels = corpus(spark, 100)
    odd = documents(spark, odd_rows(), extra=True)
    out = quality.select(odd, labels)
    assert out.count() == 8 and out.filter("doc_id in (1, 2, 3) and __log_weight <> 0").count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns
    none = spark.createDataFrame([], LABELS)
    assert quality.keep_good(odd, none).count() == 8
    assert quality.keep_good(documents(spark, []), labels).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_kth_largest(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([rng.gauss(0, 1), 0.0, 1e9, -3.5]) for _ in range(500)] + [-1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 77, 400, 501):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 502) is None and quality.kth_largest(df, "x", 0) is None


@pytest.fixture(scope="module")
def licensed(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(words(rng, 30) for _ in range(4))) for i in range(150)]
    rows += [
        (1000, words(rng, 20) + "\nLicensed under the Apache License, Version 2.0.\n" + words(rng, 9)),
        (1001, "RELEASED UNDER THE MIT LICENSE!"),
        (1002, "the license of a version under work free general public terms"),
        (1003, words(rng, 30) + " This work is licensed under the GNU General Public License, version 3. " + words(rng, 30)),
        (1004, "\n\nLicensed under CC BY-NC 4.0.\r\n\n"),
    ]
    return documents(spark, rows + odd_rows(), extra=True)


def test_licences(licensed):
    out = {r["doc_id"]: r for r in licences.find_licences(licensed).collect()}
    found = {d: [(f["paragraph"], f["family"]) for f in r["finds"]] for d, r in out.items() if r["finds"]}
    assert found == {1000: [(1, "apache-2.0")], 1001: [(0, "mit")], 1003: [(0, "gpl")], 1004: [(2, "cc-by-nc")]}
    assert (out[1]["n_paragraphs"], out[2]["n_paragraphs"], out[1000]["n_paragraphs"], out[1004]["n_paragraphs"]) == (1, 1, 3, 5)


def test_licences_of_near_relatives(spark):
    rng = random.Random(31)
    gnu = "{} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    creative = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    notices = {
        gnu.format("This program", "Affero ", "3"): "",
        gnu.format("This program", "", "3"): "gpl",
        gnu.format("This program", "", "2"): "gpl",
        gnu.format("This library", "Lesser ", "2.1"): "lgpl",
        creative.format(""): "cc-by",
        creative.format("-ShareAlike"): "cc-by-sa",
        creative.format("-NonCommercial"): "cc-by-nc",
        creative.format("-NonCommercial-ShareAlike"): "",
        creative.format("-NonCommercial-NoDerivatives"): "",
        creative.format("-NoDerivatives"): "",
        "Licensed under CC BY 4.0.": "cc-by",
        "Licensed under CC BY-ND 4.0.": "",
        "Licensed under CC BY-NC-SA 4.0.": "",
        "Released under the MIT License. Licensed under CC BY-NC 4.0.": "cc-by-nc,mit",
    }
    rows = [(i, words(rng, 60)) for i in range(400)]
    rows += [(1000 + i, f"{words(rng, 15)}\n{n}\n{words(rng, 15)}") for i, n in enumerate(notices)]
    rows += [(2000 + i, f"{words(rng, 300)} {n} {words(rng, 300)}") for i, n in enumerate(notices)]
    got = {r["doc_id"]: r["families"] for r in licences.summary(licences.find_licences(documents(spark, rows))).collect()}
    wanted = {base + i: f for base in (1000, 2000) for i, f in enumerate(notices.values())}
    assert {i: f for i, f in got.items() if i >= 1000} == wanted
    assert not any(f for i, f in got.items() if i < 1000)


def test_licences_of_empty_table(spark):
    assert licences.find_licences(documents(spark, [])).count() == 0


@pytest.fixture(scope="module")
def long_lines(spark):
    """Notices at several places of lines of 5,000 words, and texts that are one line."""
    rng = random.Random(4)
    rows = [(i, words(rng, 600)) for i in range(100)] + [(100 + i, "\n".join(words(rng, 30) for _ in range(4))) for i in range(50)]
    notices = {
        1000: (0, "Licensed under the Apache License, Version 2.0."),
        1001: (2489, "This work is licensed under the GNU General Public License, version 3."),
        1002: (4013, "Released under the MIT License."),
        1003: (5000, "Licensed under CC BY-NC 4.0."),
        1004: (2491, licences.TEMPLATES["apache-2.0"][2]),
        1005: (777, licences.TEMPLATES["gpl"][1]),
    }
    for doc, (at, notice) in notices.items():
        w = words(rng, 5000).split()
        rows.append((doc, " ".join(w[:at] + [notice] + w[at:])))
    rows.append((1006, f"{words(rng, 900)} Released under the MIT License. {words(rng, 900)} {licences.TEMPLATES['gpl'][0]} {words(rng, 900)}"))
    return documents(spark, rows)


def test_licences_inside_long_lines(long_lines):
    out = {r["doc_id"]: r for r in licences.find_licences(long_lines).collect()}
    found = {d: sorted((f["paragraph"], f["family"]) for f in r["finds"]) for d, r in out.items() if r["finds"]}
    family = {1000: "apache-2.0", 1001: "gpl", 1002: "mit", 1003: "cc-by-nc", 1004: "apache-2.0", 1005: "gpl"}
    assert found == {d: [(0, f)] for d, f in family.items()} | {1006: [(0, "gpl"), (0, "mit")]}
    brief = {r["doc_id"]: r for r in licences.summary(licences.find_licences(long_lines)).collect()}
    assert (brief[1006]["n_licence_paragraphs"], brief[1006]["families"]) == (1, "gpl,mit")


def test_licence_windows_cover_every_word():
    sizes = [0, 1, 20, 21, 40, 41, 60, 61, 5000]
    rows = np.concatenate(([0], np.cumsum(sizes)))
    first, last, line = licences.windows(rows)
    assert (last - first <= licences.WINDOW).all() and (rows[line] <= first).all() and (last <= rows[line + 1]).all()
    assert set(np.concatenate([np.arange(a, b) for a, b in zip(first, last)])) == set(range(rows[-1]))
