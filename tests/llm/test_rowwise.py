"""Decontamination, lines, secrets, mixing: odd rows and brute force."""

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairedsense.llm import decontam, lines, mixing, secrets
from .helpers import documents, odd_rows, words

ITEMS = "item_id long, text string"


def test_leaks_offsets_and_windows(spark):
    rng = random.Random(1)
    item = words(rng, 14)
    text = "Vor É. " + item.upper().replace(" ", ", ", 3) + "! nach"
    bench = spark.createDataFrame([(1, item), (2, "Short One"), (3, None), (4, "..."), (2, "short one")], ITEMS)
    docs = documents(spark, [(1, text), (2, "a short, ONE b"), (3, item.rsplit(" ", 5)[0]), (4, None)], extra=True)
    out = {r["doc_id"]: r for r in decontam.find_leaks(docs, bench).collect()}
    assert (out[1]["n_hit"], out[1]["items"]) == (14, ["1"])
    assert [text[s["start"] : s["end"]] for s in out[1]["spans"]] == [text[7:-6]]
    assert (out[2]["n_hit"], out[2]["items"]) == (2, ["2"]) and out[3]["n_hit"] == 0 and out[4]["n_words"] == 0
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4}
    assert [r["n_words"] for r in kept.orderBy("doc_id").collect()] == [r["n_words"] for r in docs.filter("doc_id in (3, 4)").orderBy("doc_id").collect()]


def test_several_automata_find_the_same(spark):
    rng = random.Random(2)
    items = [(i, words(rng, rng.choice([3, 9, 12, 25]))) for i in range(30)]
    texts = [(i, words(rng, 30) + " " + " ".join(rng.choice(items)[1] for _ in range(3)) + " " + words(rng, 5)) for i in range(20)] + odd_rows()
    docs, bench = documents(spark, texts), spark.createDataFrame(items, ITEMS)
    one = decontam.find_leaks(docs, bench)
    many = decontam.find_leaks(docs, bench, max_bytes=600)
    take = lambda df: sorted(map(str, df.select("doc_id", "n_words", "n_hit", "items", "spans").collect()))
    assert take(one) == take(many) and one.filter("n_hit > 0").count() == 20


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontam.summary(decontam.find_leaks(documents(spark, odd_rows()), none)).filter("contaminated or n_items > 0").count() == 0
    assert decontam.find_leaks(documents(spark, []), none).count() == 0


def brute_lines(rows, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    where = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                where[k].append(doc)
    out = []
    for doc, text in rows:
        kept = [x for x in (text or "").split("\n") if len(where[key(x)]) < min_docs or max(d for d in where[key(x)] if d is not None) == doc]
        out.append((doc, "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (6, 2)])
def test_lines_against_brute_force(spark, batches, fanout):
    rng = random.Random(3)
    pool = [words(rng, 12) for _ in range(30)] + ["é" * 39, "É" * 40, "short"]
    rows = [(i, "\n".join(("  " * rng.randrange(2)) + rng.choice(pool).replace("w1", "W1") for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [r for r in odd_rows() if r[0] != 5]
    got = lines.dedup_lines(documents(spark, rows, extra=True), batches=batches, fanout=fanout)
    assert sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str) == brute_lines(rows)


def test_lines_of_empty_table_and_batches_anti_join(spark):
    assert lines.dedup_lines(documents(spark, [])).count() == 0
    runs = lines.Runs(spark, fanout=2)
    line = "x" * 40
    first = lines.hash_lines(documents(spark, [(i, line) for i in range(3)])).drop("batch")
    second = lines.hash_lines(documents(spark, [(i, line + "\n" + "y" * 50) for i in range(7, 10)])).drop("batch")
    runs.add(first)
    assert runs.repeated(first, 4).count() == 0
    runs.add(second)
    assert len(runs.levels[0]) == 0 and len(runs.levels[1]) == 1
    assert {r["doc_id"] for r in runs.repeated(first.union(second), 4).collect()} == {0, 1, 2, 7, 8}


def spans_of(text):
    found = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for i, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        found += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return ",".join(x[2] for x in sorted(found))


def test_secrets_base_against_regex(spark):
    rng = random.Random(4)
    bits = ["token: ab", 'PASSWORD="abcdef12"', "api_key = 'Zz9+/=._-'", "AKIA" + "Q7" * 8, "AKIAQ", "deadbeef" * 3, "0123456789abcdef0123456", "é", "\n", "secret=token=abcdefgh", "password: token=abcdefg"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(12))) + "ſecret=abcdefgh") for i in range(40)] + odd_rows()
    got = secrets.summary(secrets.find_secrets(documents(spark, rows, extra=True))).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == sorted((str(d), hashlib.sha256(spans_of(t or "").encode()).hexdigest()) for d, t in rows)
    assert secrets.find_secrets(documents(spark, [])).count() == 0


def test_endpoints_start_at_the_first_letter_of_a_run(spark):
    rng = random.Random(3)
    bits = ["a1", "+", "9", "://", "b.c", "/", " ", "x", "token: abcdef1", "12ab://h-1", "Q"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(300)]
    found = secrets.find_secrets(documents(spark, list(enumerate(texts))), scope=10**6).collect()
    seen = 0
    for row in found:
        text = texts[row["doc_id"]]
        every = [m.span() for m in re.finditer(r"[a-z][a-z0-9+]*://[A-Za-z0-9.:@_-]+", text)]
        got = [(x["start"], x["end"]) for x in row["found"] if x["kind"] == "endpoint"]
        assert set(got) <= set(every)
        strong = [(x["start"], x["end"]) for x in row["found"] if x["kind"] == "assign"]
        assert got == [e for e in every if any(s[0] >= e[1] or e[0] >= s[1] for s in strong)]
        seen += len(got)
    assert seen > 50


@pytest.mark.parametrize("unit", ["a", "0", "abcdef0123", "a+1", "AKIA", "token", "Ab0+", "token: ", "a://"])
def test_secrets_of_a_million_characters(spark, unit):
    text = (unit * 10**6)[: 10**6] + " https://example.org/x password: abcdef99"
    began = time.monotonic()
    found = secrets.find_secrets(documents(spark, [(1, text)])).collect()[0]["found"]
    assert time.monotonic() - began < 60
    assert found[-1]["kind"] == "assign" and found[-1]["end"] == len(text)


def test_secrets_weak_parts_need_a_complement(spark):
    value = "Ab3" * 12
    near = f"see https://db.example.com:5432 with password=hunter22 and username: svc {value}"
    far = f"https://db.example.com:5432 {'.' * 300} password=hunter22 {'.' * 300} {value}"
    got = {r["doc_id"]: r["spans"] for r in secrets.summary(secrets.find_secrets(documents(spark, [(1, near), (2, far), (3, value)]))).collect()}
    assert [x.split(":")[0] for x in got[1].split(",")] == ["endpoint", "assign", "account", "value"]
    assert [x.split(":")[0] for x in got[2].split(",")] == ["assign"] and got[3] == ""


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(400)]
    out = mixing.mix(documents(spark, rows, extra=True)).collect()
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in out:
        size[r["source"]] += r["__size"]
        target[r["source"]] = r["__target"]
        taken[r["source"]] += r["__taken"]
        assert r["__source_size"] == sum(len((t or "").split()) for _, t, s in rows if s == r["source"])
        assert r["__taken"] <= 3 * r["__size"]
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    clamped = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in clamped)
        free = [s for s in size if s not in clamped]
        want = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3.0 * size[s] for s in clamped}
        over = {s for s in free if want[s] > 3 * size[s]}
        if not over:
            break
        clamped |= over
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    again = mixing.mix(documents(spark, rows[::-1])).select("doc_id", "__taken").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["__taken"]) for r in out)


def test_mix_of_odd_rows(spark):
    out = mixing.mix(documents(spark, odd_rows()))
    assert out.count() == 8 and out.filter("__taken > 3 * __size").count() == 0
    assert mixing.mix(documents(spark, [])).count() == 0
    blank = mixing.mix(documents(spark, [(1, ""), (2, None)])).agg(F.sum("__taken"), F.max("__target")).first()
    assert tuple(blank) == (0, 0.0)
