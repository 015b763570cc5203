"""Ranked search and hard negatives against brute force, with odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairedsense.llm import lexical, negatives
from .helpers import CLASHING, documents, odd_rows, words

ITEMS = "item_id long, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_search(rows, items, k):
    docs = [(d, terms(t)) for d, t in rows]
    docs = [(d, w, Counter(w)) for d, w in docs if w]
    total, n_docs = sum(len(w) for _, w, _ in docs), len(docs)
    df = Counter(t for _, _, c in docs for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in queries.items():
        scored = []
        for d, w, c in docs:
            m = 50 + (50 * len(w) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


def found(df):
    return sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


@pytest.fixture
def corpus():
    rng = random.Random(11)
    base = [(i, words(rng, rng.randrange(3, 60), 90)) for i in range(10, 260)]
    copies = [(i, base[3][1]) for i in range(300, 380)]
    items = [(i, words(rng, rng.choice([1, 4, 12, 30]), 110)) for i in range(25)]
    items += [(30, items[2][1] + " " + items[3][1]), (31, items[2][1]), (2, "é W1 w1 w2"), (None, "w3 w4"), (40, None), (41, "..."), (42, "nowhere"), (43, "É é")]
    return base + copies + odd_rows(), items


@pytest.mark.parametrize("max_entries, cells", [(1 << 20, 1 << 21), (60, 2000)])
def test_search_against_brute_force(spark, corpus, max_entries, cells, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", cells)
    rows, items = corpus
    docs, queries = documents(spark, rows, extra=True).repartition(7), spark.createDataFrame(items, ITEMS).withColumn("query", F.lit(1)).withColumn("term", F.lit("x"))
    assert found(lexical.search(docs, queries, 7, max_entries=max_entries)) == brute_search(rows, items, 7)


def test_search_of_empty_tables(spark, corpus):
    rows, items = corpus
    assert lexical.search(documents(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0
    none = lexical.search(documents(spark, rows), spark.createDataFrame([], ITEMS))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(documents(spark, rows), spark.createDataFrame([(1, None), (2, "?")], ITEMS)).count() == 0


def test_shared_sets_add_up(spark):
    rng = random.Random(3)
    queries = [sorted(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(30)] + [[5], [], list(range(60))]
    plan = lexical.share(queries, 60)
    below = {i: {t for t in range(60) if plan.set_of[t] == i} for i in range(plan.smallest)}
    for i, (a, b) in enumerate(plan.joins.tolist()):
        assert a < plan.smallest + i and b < plan.smallest + i and not below[a] & below[b]
        below[plan.smallest + i] = below[a] | below[b]
    for own, sets in zip(queries, plan.queries):
        parts = [below[s] for s in sets.tolist()]
        assert sum(map(len, parts)) == len(own) and set().union(*parts) == set(own)
    assert plan.additions < sum(max(len(q) - 1, 0) for q in queries) * 0.7
    alike = lexical.share([list(range(50))] * 9, 50)
    assert alike.smallest == 1 and alike.additions == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, positives=5, negatives=3):
    live = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            live.append((i, [math.floor(256 * x) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, label in live:
        if i % 50:
            continue
        mine = sorted((-dot(v, w), j) for j, w, other in live if j != i and other == label)[:positives]
        theirs = sorted((-dot(v, w), j) for j, w, other in live if other != label)
        for s, p in mine:
            inside = [(n, j) for n, j in theirs if 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out += [(i, p, r + 1, j, -s, -n) for r, (n, j) in enumerate(inside)]
    return sorted(out)


def vectors(rng, n, dims=12):
    f = lambda x: float(int(x * 256)) / 256 + 1 / 1024  # noqa: E731  exact in 32 bits
    rows = [(i, [f(rng.gauss(0.5, 1)) for _ in range(dims)], rng.randrange(3)) for i in range(n)]
    rows += [(1000 + i, rows[7][1], i % 2) for i in range(40)]  # ties
    rows += [(2000, [], 1), (2050, [1.0, 2.0], 1), (2100, None, 1), (2150, [1.0] * dims, None), (2200, [float("nan")] * dims, 1), (2250, [None] * dims, 1),
             (2300, [float("inf")] + [0.0] * (dims - 1), 1), (None, [1.0] * dims, 1), (2350, [0.0] * dims, 1), (2400, [9.0] * dims, 7), (3, rows[3][1], rows[3][2])]
    return rows


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("block, group, step", [(8192, 16384, 8), (37, 4, 5)])
def test_negatives_against_brute_force(spark, monkeypatch, block, group, step):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "STEP", step)
    rows = vectors(random.Random(4), 320)
    table = spark.createDataFrame(rows, VECTORS)
    for name in CLASHING + ["id", "anchor", "slot", "score"]:
        table = table.withColumn(name, F.lit(1))
    out = mined(negatives.mine(table, group=group))
    assert out == brute_negatives(rows) and len(out) > 50


def test_negatives_of_large_components(spark):
    rng = random.Random(5)
    rows = [(i, [float(2**19 * rng.randrange(-9, 9)) for _ in range(4)], i % 2) for i in range(60)]
    assert mined(negatives.mine(spark.createDataFrame(rows, VECTORS))) == brute_negatives(rows)
    tens = [(i, [float(2**12 * rng.randrange(-9, 9)) for _ in range(4)], i % 2) for i in range(60)]
    assert mined(negatives.mine(spark.createDataFrame(tens, VECTORS))) == brute_negatives(tens)


def test_negatives_of_small_tables(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.mine(spark.createDataFrame([(50, [1.0], 1)], VECTORS)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1), (2, [0.7], 2)], VECTORS)).count() == 0
    one = spark.createDataFrame([(50, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)], VECTORS)
    assert mined(negatives.mine(one)) == [(50, 1, 1, 2, 65536, 49152)]
