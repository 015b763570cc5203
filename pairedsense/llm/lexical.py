"""Ranked lexical search of many queries at once, by shared partial sums.

All queries are answered by one pass over the documents' postings:

1. Texts are read once. What stays of a document is its length and its counts of
   the query terms; these rows are written and read by the later passes.
2. Sums over them give the weights of the terms.
3. Shared term sets are mined among the queries: terms that the same queries hold
   are one set; then, with every query's sets in the order of falling use, sets
   that are neighbours in two or more queries are joined into a larger set, until
   no two are. A set has two smaller sets or terms below it, so the sets form a
   graph that the queries share.
4. A task takes some documents at a time, sums the impacts of every smallest set
   once, adds the larger ones up along the graph, and reads each query's score as
   the sum of its few sets. It keeps the best documents per query; these are
   merged in two steps, so no query's candidates meet in one task unless few.

The queries go to the tasks in blocks of at most about ``MAX_ENTRIES`` (query, term)
pairs; further blocks are passes of their own, so what is broadcast is bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import text as tx

MAX_ENTRIES = 1 << 20
CELLS = 1 << 21  # entries of the sums that a task holds at a time
BUCKETS = 32
NO_ID = np.iinfo(np.int64).max

# Fixed: a term is a run of ASCII letters, digits and characters beyond ASCII.
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def query_terms(queries: DataFrame, key: str = "item_id") -> DataFrame:
    """(query, term) of every distinct term of a query; queries with an equal id are one."""
    words = F.expr(f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), r'({_PATTERN})', 1)")
    return queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(words)).alias("term")).distinct()


def term_hashes(terms: list[str]) -> np.ndarray:
    """The hash that ``_count`` gives to each of these words."""
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    return tx.hash_spans(np.frombuffer(b"".join(raw), np.uint8), starts, ends)


def _count(sent):
    """Per document with a term: its id, its terms with repeats, and its query terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: np.ndarray = sent.value  # ascending hashes of the query terms
        for batch in batches:
            ids = batch.column(0)
            for piece in tx.slices(batch.column(1)):
                starts, ends, rows = tx.segments(_APART[piece.data].view(np.uint8), piece.bounds, 1)
                hashes = tx.hash_spans(tx.LOWER[piece.data], starts, ends)
                lengths = np.diff(rows)
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                row = np.repeat(np.arange(len(lengths)), lengths)[hit]
                pairs, counts = np.unique(row * max(len(known), 1) + at[hit], return_counts=True)
                row, term = np.divmod(pairs, max(len(known), 1))
                there = np.flatnonzero(lengths)
                offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(lengths))[there])].astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (term, counts)]
                own = ids.slice(piece.first, len(piece)).take(pa.array(there))
                yield pa.RecordBatch.from_arrays([own.cast(pa.int64()), pa.array(lengths[there]), *made], names=["doc_id", "n", "terms", "counts"])

    return run


@dataclass
class Plan:
    """Sets of terms that queries share. Numbers below ``smallest`` are smallest sets, ``smallest + i`` joins the sets ``joins[i]``."""

    set_of: np.ndarray  # term -> its smallest set
    smallest: int
    joins: np.ndarray  # (larger sets, 2), each after the sets that it joins
    levels: np.ndarray  # ascending
    queries: list[np.ndarray]  # the sets of every query, disjoint

    @property
    def sets(self) -> int:
        return self.smallest + len(self.joins)

    @property
    def additions(self) -> int:
        """Additions of document sums that the queries need."""
        return len(self.joins) + sum(max(len(q) - 1, 0) for q in self.queries)


def share(queries: list[list[int]], terms: int) -> Plan:
    """The plan of queries that are lists of distinct term numbers below ``terms``."""
    held: list[list[int]] = [[] for _ in range(terms)]
    for q, own in enumerate(queries):
        for t in own:
            held[t].append(q)
    by_queries: dict[tuple[int, ...], list[int]] = {}
    for t, of in enumerate(held):
        by_queries.setdefault(tuple(of), []).append(t)
    ordered = sorted((of for of in by_queries if of), key=lambda of: (-len(of), of))
    set_of = np.full(terms, -1, np.int64)
    rows: list[list[int]] = [[] for _ in queries]
    for number, of in enumerate(ordered):
        set_of[by_queries[of]] = number
        for q in of:
            rows[q].append(number)
    joins: list[tuple[int, int]] = []
    level = [0] * len(ordered)
    while True:
        pairs = Counter(p for row in rows for p in zip(row, row[1:]))
        pairs = {p: n for p, n in pairs.items() if n > 1}
        if not pairs:
            break
        chosen: list[list[tuple[int, ...]]] = []
        for row in rows:
            out, i = [], 0
            while i < len(row):
                here = pairs.get(tuple(row[i : i + 2]), 0) if i + 1 < len(row) else 0
                after = pairs.get(tuple(row[i + 1 : i + 3]), 0) if i + 2 < len(row) else 0
                if here and here >= after:
                    out.append((row[i], row[i + 1]))
                    i += 2
                else:
                    out.append((row[i],))
                    i += 1
            chosen.append(out)
        used = Counter(p for out in chosen for p in out if len(p) == 2)
        names: dict[tuple[int, ...], int] = {}
        for p, n in used.items():
            if n > 1:
                names[p] = len(ordered) + len(joins)
                joins.append((p[0], p[1]))
                level.append(1 + max(level[p[0]], level[p[1]]))
        if not names:
            # Every chosen pair stands alone: take the most frequent pair by itself.
            best = max(pairs, key=lambda p: (pairs[p], p))
            names[best] = len(ordered) + len(joins)
            joins.append(best)
            level.append(1 + max(level[best[0]], level[best[1]]))
            chosen = [_with(row, best) for row in rows]
        rows = [[x for p in out for x in ([names[p]] if p in names else p)] for out in chosen]
    own = np.array(level[len(ordered) :], np.int64)
    order = np.argsort(own, kind="stable")  # by level, so that a level is one vector addition
    place = np.arange(len(level))
    place[len(ordered) + order] = len(ordered) + np.arange(len(order))
    pairs_of = np.array(joins, np.int64).reshape(-1, 2)[order]
    return Plan(set_of, len(ordered), place[pairs_of], own[order], [place[np.array(row, np.int64)] for row in rows])


def _with(row: list[int], pair: tuple[int, int]) -> list[tuple[int, ...]]:
    out, i = [], 0
    while i < len(row):
        if tuple(row[i : i + 2]) == pair:
            out.append(pair)
            i += 2
        else:
            out.append((row[i],))
            i += 1
    return out


class Best:
    """The k best (score, then least id) documents of every query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor, self.last = np.zeros(queries, np.int64), np.full(queries, np.iinfo(np.int64).min)
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: queries x documents."""
        query, at = np.nonzero(scores >= np.maximum(self.floor, 1)[:, None])
        value, who = scores[query, at], ids[at]
        # At the limit a document enters only before the one that stands last.
        fresh = (value > self.floor[query]) | (who < self.last[query])
        if not fresh.any():
            return
        query, who, value = np.r_[self.query, query[fresh]], np.r_[self.id, who[fresh]], np.r_[self.score, value[fresh]]
        order = np.lexsort((who, -value, query))
        query, who, value = query[order], who[order], value[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.id, self.score = query[kept], who[kept], value[kept]
        full = place[kept] == self.k - 1
        self.floor[self.query[full]], self.last[self.query[full]] = self.score[full], self.id[full]


def _rank(sent, k: int):
    """Each task's k best documents of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights, documents, total = sent.value
        best = Best(len(plan.queries), k)
        width = max(1, CELLS // max(plan.sets, len(plan.queries), 1))
        levels = [(plan.smallest + a, plan.smallest + b) for a, b in zip(*_runs(plan.levels))]
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            n = batch.column("n").to_numpy()
            lists = batch.column("terms")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets, terms = offsets - offsets[0], lists.flatten().to_numpy()
            counts = batch.column("counts").flatten().to_numpy().astype(np.int64)
            m = 100 - 50 + (50 * n * documents) // total
            for first in range(0, len(ids), width):
                end = min(first + width, len(ids))
                a, b = offsets[first], offsets[end]
                doc = np.repeat(np.arange(end - first), np.diff(offsets[first : end + 1]))
                tf, term = counts[a:b], terms[a:b]
                impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[first + doc]))
                sums = np.zeros((plan.sets, end - first), np.int64)
                used = plan.set_of[term] >= 0
                np.add.at(sums, (plan.set_of[term][used], doc[used]), impact[used])
                for low, high in levels:
                    pairs = plan.joins[low - plan.smallest : high - plan.smallest]
                    sums[low:high] = sums[pairs[:, 0]] + sums[pairs[:, 1]]
                best.add(np.stack([sums[q].sum(axis=0) for q in plan.queries]), ids[first:end])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.query), pa.array(best.id, mask=best.id == NO_ID), pa.array(best.score)], names=["query", "doc_id", "score"]
        )

    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last place of each run of equal values."""
    if not len(values):
        return values, values
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    return edges[:-1], edges[1:]


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "item_id", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The k best documents of every query: (``key``, rank from 1, doc_id, score).

    With N documents that have a term, L terms in all, n of the document, df documents with the term and
    tf occurrences in the document, a term weighs w = floor(1000 ln((2N+2) / (2df+1))) and adds
    w * (10^9 tf div (1000 tf + 20 m)), m = 100 - 50 + (50 n N div L). Only scores above 0 count.

    * Null and empty texts, and texts without terms, are no documents and no queries.
    * Equal scores stand by rising doc_id, a null doc_id last; rows with an equal doc_id are documents of their own.
    * Queries with an equal id (null too) are one query with the terms of all.
    * Empty tables give no rows. Other columns are ignored, whatever their names.
    * A word is known by 64 bits of its hash.
    """
    spark = docs.sparkSession
    entries = stage(query_terms(queries, key), "queries")
    kind = queries.schema[key].dataType.simpleString()
    blocks = max(1, -(-entries.count() // max_entries))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in range(blocks):
        own = entries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()  # about max_entries rows
        if not own:
            continue
        names = sorted({r["term"] for r in own})
        hashes = term_hashes(names)
        order = np.argsort(hashes)
        number = {names[i]: at for at, i in enumerate(order.tolist())}
        postings = stage(texts.mapInArrow(_count(spark.sparkContext.broadcast(hashes[order])), "doc_id long, n long, terms array<int>, counts array<int>"), "postings")
        documents, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # a row per query term at most
        weights = np.zeros(len(names), np.int64)
        for r in found:
            weights[r["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
        of: dict = {}
        for r in own:
            if weights[number[r["term"]]] > 0:
                of.setdefault(r["query"], []).append(number[r["term"]])
        if not of:
            continue
        ids = list(of)
        plan = share([of[q] for q in ids], len(names))
        sent = spark.sparkContext.broadcast((plan, weights, int(documents), int(total)))
        scored = postings.mapInArrow(_rank(sent, k), "query long, doc_id long, score long")
        near = _top(scored.withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(BUCKETS))), ["query", "bucket"], k).drop("bucket", "rank")
        called = spark.createDataFrame(list(enumerate(ids)), f"query long, `{key}` {kind}")
        ranked = _top(near, ["query"], k).join(called, "query").select(key, F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return spark.createDataFrame([], f"`{key}` {kind}, rank int, doc_id long, score long")
    return out
