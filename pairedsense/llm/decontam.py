"""Benchmark decontamination with one Aho-Corasick automaton over the normalised items.

The windows (10 words, or a whole shorter item) of all items become the patterns
of one automaton; it is built in every worker and walks each text once. A
normalised text is its words with single spaces, so a pattern between spaces is
found at word bounds only; word numbers lead back to the offsets in the
original text.

The patterns are sent to the executors, so their size is looked at first: up to
``MAX_BYTES`` of patterns go into one automaton, more are cut by a hash into
blocks of at most about that size, each scanned in a pass of its own, and the
hit words of the passes are united per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

WINDOW = 10
MAX_BYTES = 64 << 20

_TABLE = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def normalised(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, as bytes."""
    return raw.translate(_TABLE).split()


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = normalised(text.as_buffer().to_pybytes()) if text.is_valid else []
                if words:
                    each = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
                    items += [item] * len(each)
                    found += [w.decode("utf-8") for w in each]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.string())], names=["item", "window"])

    return run


def _automaton(patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for window, items in patterns:
        key = f" {window} ".encode().decode("latin-1")
        machine.add_word(key, (window.count(" ") + 1, items))
    if len(machine):
        machine.make_automaton()
    return machine


def _original(text: str, words: list[int]) -> list[dict]:
    """Spans in the original text of runs of hit words (ascending word numbers)."""
    hit, spans, last = set(words), [], None
    for i, m in enumerate(_WORD.finditer(text)):
        if i in hit:
            if last == i - 1 and spans:
                spans[-1]["end"] = m.end()
            else:
                spans.append({"start": m.start(), "end": m.end()})
            last = i
    return spans


def _scan(sent, names: list[str], with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(sent.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            rows: list[tuple] = []
            for text in texts:
                words = normalised(text.as_buffer().to_pybytes()) if text.is_valid else []
                found: list[tuple[int, int, list[str]]] = []
                if words and len(machine):
                    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
                    found = [(end, n, items) for end, (n, items) in machine.iter(line)]
                if not found:
                    rows.append((len(words), 0, [], []))
                    continue
                # number of the word that a closing space follows
                gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                marks = np.zeros(len(words) + 1, np.int64)
                items = set()
                for end, n, of in found:
                    last = int(np.searchsorted(gaps, end))
                    marks[last - n] += 1
                    marks[last] -= 1
                    items.update(of)
                hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                spans = _original(text.as_py(), hit.tolist()) if with_spans else []
                rows.append((len(words), len(hit), sorted(items), spans))
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            made = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.string())),
                pa.array([r[3] for r in rows], span),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*names, "n_words", "n_hit", "items", "spans"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids) and spans (code points of the original text, end exclusive).

    A word is hit if it lies in an occurrence of an item's window.

    * A null text and one without words have no words and no hits.
    * Items without words are in nothing; items with an equal id are one item; an item without id is named "".
    * Columns of ``docs`` stay; n_words, n_hit, items and spans of its own are replaced. Empty tables give no hits.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "items", "spans")
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    windows = named.mapInArrow(_windows(window), "item string, window string")
    patterns = stage(windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")), "patterns")
    total = patterns.agg(F.sum(F.octet_length("window") + F.expr("aggregate(items, 0, (n, x) -> n + octet_length(x))"))).first()[0] or 0
    blocks = max(1, -(-int(total) // max_bytes))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def scanned(block: int, source: DataFrame, spans: bool) -> DataFrame:
        own = patterns.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([(r["window"], list(r["items"])) for r in own.toLocalIterator()])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
        return source.mapInArrow(_scan(sent, source.columns, spans), f"{schema}, {_HITS}")

    if blocks == 1:
        return scanned(0, docs, True)
    # More patterns than one automaton may hold: a pass per block over numbered rows, united per row.
    rows = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    parts = None
    for block in range(blocks):
        part = stage(scanned(block, rows.select("__row", "text"), True).drop("text"), "block")
        parts = part if parts is None else parts.union(part)
    words = parts.groupBy("__row").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")
    )
    return rows.join(words, "__row").mapInArrow(_unite(docs.columns), f"{fields}, {_HITS}")


def _unite(names: list[str]):
    """Spans of several passes, united; n_hit counts the words that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            hits, spans = [], []
            for text, own in zip(table["text"], table["spans"].to_pylist()):
                joined = _merge(text.as_py(), own)
                spans.append(joined[1])
                hits.append(joined[0])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*[table[n] for n in names], table["n_words"], pa.array(hits, pa.int64()), table["items"], pa.array(spans, span)],
                names=[*names, "n_words", "n_hit", "items", "spans"],
            )

    return run


def _merge(text: str | None, spans: list[dict]) -> tuple[int, list[dict]]:
    if not spans or text is None:
        return 0, []
    marks = np.zeros(len(text) + 1, np.int64)
    for s in spans:
        marks[s["start"]] += 1
        marks[s["end"]] -= 1
    covered = np.cumsum(marks) > 0
    words = [i for i, m in enumerate(_WORD.finditer(text)) if covered[m.start()]]
    return len(words), _original(text, words)


def summary(found: DataFrame) -> DataFrame:
    """Digest columns of a result of ``find_leaks``."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item; the same columns, of whatever name."""
    own = [c for c in ("n_words", "n_hit", "items", "spans") if c in docs.columns]
    safe = docs.withColumnsRenamed({c: f"__own_{c}" for c in own})
    kept = find_leaks(safe, benchmark, **options).filter("n_hit = 0").drop("n_words", "n_hit", "items", "spans")
    return kept.withColumnsRenamed({f"__own_{c}": c for c in own}).select(*docs.columns)
