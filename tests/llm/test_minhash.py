import random
import re

import pytest

from pairedsense.llm import minhash
from pairedsense.llm.components import components
from .helpers import documents, odd_rows, words


def brute(rows):
    """(doc_id -> (size, component)) by all pairs."""
    sets = {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_against_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for group in range(12):
        base = words(rng, rng.choice([4, 8, 60, 300]))
        for _ in range(rng.choice([1, 2, 5])):
            rows.append(edited(rng, base, rng.choice([0, 0, 1, 3])) if len(base.split()) > 20 else base)
    passage = words(rng, 100)
    for _ in range(60):  # a shared passage is most of a short document, but not enough for a link
        rows.append(words(rng, 40) + " " + passage + " " + words(rng, 20))
    step = words(rng, 200)
    for _ in range(15):  # a chain: neighbours are linked, ends are not
        step = edited(rng, step, 4)
        rows.append(step.upper() if rng.random() < 0.3 else step)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == want


def test_large_group_and_clashing_columns(spark):
    rng = random.Random(2)
    base = words(rng, 150)
    rows = [(i, edited(rng, base, 3)) for i in range(400)] + [(1000 + i, base) for i in range(200)]
    docs = documents(spark, rows, extra=True)
    out = minhash.near_duplicates(docs).collect()
    assert {r["component_id"] for r in out} == {v[1] for v in brute(rows[:60] + rows[400:420]).values()}
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_odd_rows(spark):
    out = minhash.near_duplicates(documents(spark, odd_rows())).collect()
    assert len(out) == 8
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 5)] == [0, 0, 0, 1]
    assert by[None]["component_id"] is None and by[None]["kept"] and by[None]["n_shingles"] == 2
    assert all(by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 3, 4, 5, 6))
    assert minhash.near_duplicates(documents(spark, [])).collect() == []


def test_one_document_of_several_texts_links_them(spark):
    a, b = words(random.Random(3), 50), words(random.Random(4), 50)
    out = minhash.near_duplicates(documents(spark, [(1, a), (2, b), (9, a), (9, b)])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(1, 1), (2, 1), (9, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {(r["node"], r["component"]) for r in got} == {(x, root(x)) for x in parent}
