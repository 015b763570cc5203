"""Every stage of the pipeline against brute force on its own input."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from pairedsense.llm import quality
from pairedsense.session import stage
from .helpers import documents, odd_rows
from .test_minhash import brute
from .test_models import brute_weights
from .test_rowwise import brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, step in pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        seen.append(docs)
    return [d.toPandas() for d in seen]


def test_columns(steps):
    for df in steps[1:-1]:
        assert list(df.columns) == list(steps[0].columns)
    assert (steps[2].n_chars == steps[2].text.fillna("").str.len()).all()


def test_quality(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.createDataFrame(steps[0])
    weights = brute_weights(docs, labels)
    noise = {r["doc_id"]: r["n"] for r in docs.select("doc_id", quality._noise("quality-1").alias("n")).collect()}
    known = labels.filter("quality is not null").toPandas()
    k = round(known.quality.mean() * len(steps[0]))
    best = sorted(weights, key=lambda d: -(weights[d] + noise[d]))[:k]
    assert set(steps[1].doc_id) == set(best)


def test_lines(steps):
    assert sorted(zip(steps[2].doc_id, steps[2].text.fillna("")), key=str) == brute_lines(list(zip(steps[1].doc_id, steps[1].text)))


def test_near_duplicates(steps):
    groups = brute(list(zip(steps[2].doc_id, steps[2].text)))
    assert set(steps[3].doc_id) == {d for d, (_, component) in groups.items() if d == component}


def test_decontamination(spark, steps):
    def split(text):
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} - {()}
    sizes = {len(w) for w in windows}
    clean = [d for d, t in zip(steps[3].doc_id, steps[3].text) if not any(tuple(split(t)[i : i + n]) in windows for n in sizes for i in range(len(split(t)) - n + 1))]
    assert sorted(steps[4].doc_id) == sorted(clean)


def test_mixture(steps):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in steps[4].itertuples():
        size[r.source] += len((r.text or "").split())
    for r in steps[5].itertuples():
        assert 0 < r.taken <= 3 * r.size and r.taken == r.copies * r.size + r.part_words and r.source_size == size[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sum(taken.values()) == pytest.approx(sum(size.values()), abs=len(size))


def test_run_is_the_last_stage(spark, steps):
    got = pipeline.run(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = steps[-1].sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns])


def test_stages_take_odd_rows_and_extra_columns(spark):
    docs = documents(spark, odd_rows(), extra=True)
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= 8
        assert step(spark, documents(spark, []), SF).count() == 0
    mixed = pipeline.mixture(spark, docs, SF)
    assert set(docs.columns) <= set(mixed.columns) and mixed.count() > 0
    assert pipeline.mixture(spark, documents(spark, []), SF).count() == 0
