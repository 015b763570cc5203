"""Toxicity from two class-conditional Kneser-Ney models, compared per word.

Bigram counts come from labelled texts, one model per class. Both back off from
(class, bigram) to (class, word) by continuation counts, and from there to one
distribution that the classes share: in how many documents of the whole corpus
a word stands. A word that neither class has seen thus says nothing.

Discounts are the ordinary ones, ``n1 / (n1 + 2 n2)`` of each class and level, so
a count of one already weighs. Beside them a context of a bigram has ``STRENGTH``
counts of its backoff, as in a Pitman-Yor model, and a word ``PRIOR`` documents of
the labelled share more than it has: what is rare says little in both classes.
Texts count once however many labelled copies they have, with the label of the
majority.

A text's evidence is its length-normalised log-likelihood difference over the
whole text, and the difference at its most toxic place, once by the full models
(a phrase) and once by the backed-off word models. At these peaks a toxic count
is lowered by one more, since a single labelled text is no witness: its label may be
wrong and the text scored may be its copy. A logistic function of the three, fitted
on labelled texts that the models have not seen, turns them into a probability.

Words are 64-bit hashes and bigrams pairs of word numbers, so no two share an
entry. The tables hold the words and bigrams of the labelled sample, at most
``MAX_LABELLED`` rows (those with the least hash of the doc_id), and are broadcast;
document counts are made on Spark for every word of all documents, and those
of the sample's words are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import text as T

MAX_LABELLED = 20_000
STRENGTH = 10.0
PRIOR = 4.0
THRESHOLD = 0.7
_START = np.uint64(0x5BD1E995)
_KIND = np.zeros(256, dtype=np.uint8)  # 1 letters and digits, 0 the rest
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def tokens(piece: T.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, A-Z lower-cased) and the rows' bounds."""
    starts, ends, rows = T.segments(_KIND[piece.data], piece.bounds, 0)
    return T.hash_spans(T.LOWER[piece.data], starts, ends), rows


def contexts(words: np.ndarray, rows: np.ndarray, start) -> np.ndarray:
    """The word before each; the first word of a row follows the start mark."""
    before = np.empty_like(words)
    if len(words):
        before[1:] = words[:-1]
        before[rows[:-1][rows[:-1] < rows[1:]]] = start
    return before


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a piece each word stands."""
    for batch in batches:
        for piece in T.slices(batch.column(0), 8 << 20):
            words, rows = tokens(piece)
            keys, where = np.unique(words, return_inverse=True)
            doc = np.repeat(np.arange(len(piece)), np.diff(rows))
            once = np.unique(doc * max(len(keys), 1) + where)
            n = np.bincount(once % max(len(keys), 1), minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(keys)), pa.array(n)], names=["w", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic (t) and ordinary (o) texts of a piece each bigram (context c, word w) stands."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for piece in T.slices(batch.column(0), 8 << 20):
            words, rows = tokens(piece)
            doc = np.repeat(np.arange(len(piece)), np.diff(rows))
            pairs = np.column_stack((contexts(words, rows, _START), words))
            order = np.lexsort((doc, pairs[:, 1], pairs[:, 0]))
            pairs, doc = pairs[order], doc[order]
            new = np.ones(len(pairs), dtype=bool)
            new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
            fresh = new.copy()
            fresh[1:] |= doc[1:] != doc[:-1]  # a text that repeats itself says it once
            group = np.cumsum(new)[fresh] - 1
            t = np.bincount(group, weights=toxic[piece.first + doc[fresh]] == 1, minlength=int(new.sum())).astype(np.int64)
            n = np.bincount(group, minlength=int(new.sum()))
            c, w = (pa.array(T.signed(np.ascontiguousarray(pairs[new, i]))) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([c, w, pa.array(t), pa.array(n - t)], names=["c", "w", "t", "o"])


def discount(counts: np.ndarray) -> float:
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return max(ones, 1) / (max(ones, 1) + 2 * twos)


class Side:
    """One class: per known bigram what is left of its count, per context the mass of its backoff, per word its backed-off share."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, shared: np.ndarray, lowered: float = 0.0) -> None:
        """``context`` and ``word`` number the bigrams' parts in the vocabulary, whose last entry stands for all other words."""
        n = len(shared)
        types = np.bincount(word[count > 0], minlength=n)
        heard = np.maximum(types - discount(types) - lowered, 0)
        every = max(types.sum(), 1)
        self.word = heard / every + (1 - heard.sum() / every) * shared  # doubles: it is summed up and divided
        left = np.maximum(count - discount(count) - lowered, 0)
        total = np.bincount(context, weights=count, minlength=n)
        stays = np.bincount(context, weights=left, minlength=n)
        self.pair = (left / (total[context] + STRENGTH)).astype(np.float32)  # the one long table
        self.back = 1 - stays / (total + STRENGTH)

    def probability(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """``pair`` is -1 for a bigram that no labelled text has."""
        own = np.where(pair >= 0, self.pair[pair], 0.0) if len(self.pair) else 0.0
        return own + self.back[context] * self.word[word]


class Model:
    """Vocabulary and bigrams of the labelled sample, the sides, and the logistic weights."""

    def __init__(self, vocabulary: np.ndarray, shared: np.ndarray, context: np.ndarray, word: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> None:
        """``vocabulary``: sorted hashes, ``shared``: their shares and that of all other words; the bigrams ascend by (context, word)."""
        # Kept and sent as counts, in the narrowest types that hold them; whoever scores builds the tables from them.
        narrow = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        per = np.bincount(context, minlength=len(shared))
        self._sent = (vocabulary, shared, narrow(per), narrow(word), narrow(toxic), narrow(ordinary))
        self.vocabulary = vocabulary
        self.weights = np.zeros(4)

    def __reduce__(self):
        return _received, self._sent

    def _bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.vocabulary) + 1), self._sent[2]), self._sent[3].astype(np.int64)

    @cached_property
    def pairs(self) -> np.ndarray:
        context, word = self._bigrams()
        return context * (len(self.vocabulary) + 1) + word

    @cached_property
    def sides(self) -> dict[str, Side]:
        shared, (toxic, ordinary), bigrams = self._sent[1], (x.astype(np.int64) for x in self._sent[4:]), self._bigrams()
        return {"t": Side(*bigrams, toxic, shared), "o": Side(*bigrams, ordinary, shared), "peak": Side(*bigrams, toxic, shared, 1.0)}

    def number(self, words: np.ndarray) -> np.ndarray:
        """Place in the vocabulary, or its length for other words."""
        n = len(self.vocabulary)
        at = np.searchsorted(self.vocabulary, words)
        known = at < n
        known[known] = self.vocabulary[at[known]] == words[known]
        return np.where(known, at, n)

    def places(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bigram or -1, context, word) as numbers of the model's tables."""
        n = len(self.vocabulary)
        keys, where = np.unique(words, return_inverse=True)
        word = self.number(keys)[where]
        context = contexts(word, rows, self.number(np.array([_START]))[0])
        both = np.flatnonzero((word < n) & (context < n))
        pair = np.full(len(words), -1, dtype=np.int64)
        if len(both) and len(self.pairs):
            wanted = context[both] * (n + 1) + word[both]
            at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
            pair[both] = np.where(self.pairs[at] == wanted, at, -1)
        return pair, context, word

    def evidence(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(rows, 3): mean log-likelihood difference per word, its highest by the full and by the word models; 0 without words."""
        n = np.diff(rows)
        out = np.zeros((len(n), 3))
        if not len(words):
            return out
        place = self.places(words, rows)
        toxic, ordinary, peak = (np.log(self.sides[c].probability(*place)) for c in ("t", "o", "peak"))
        alone = np.log(self.sides["peak"].word) - np.log(self.sides["o"].word)
        full = np.flatnonzero(n)
        at = rows[:-1][full]
        out[full, 0] = np.add.reduceat(toxic - ordinary, at) / n[full]
        out[full, 1] = np.maximum.reduceat(peak - ordinary, at)
        out[full, 2] = np.maximum.reduceat(alone[place[2]], at)
        return np.round(out, 9)  # alike in whatever piece a text is read


def probability(evidence: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = weights[0] + evidence @ weights[1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _received(vocabulary: np.ndarray, shared: np.ndarray, per: np.ndarray, *counts: np.ndarray) -> Model:
    return Model(vocabulary, shared, np.repeat(np.arange(len(shared), dtype=np.int32), per), *counts)


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Newton steps of a logistic fit with a light penalty on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [decay] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labelled: DataFrame) -> Model:
    """Models from ``labelled`` (text, toxic 0/1, calibrate) and the document counts of all words of ``docs``.

    Copies of a text are one text, with the label of the majority and in the fit if one of them is.
    Without labelled rows of both classes the fit has no slope and every score is the share of toxic rows (0.5 without any).
    """
    texts = stage(
        labelled.groupBy("text").agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"), F.min("calibrate").alias("calibrate")), "labelled_texts"
    )
    counted = texts.filter("not calibrate").select("text", "toxic").mapInArrow(_count, "c long, w long, t long, o long")
    kind = "short" if texts.count() < 1 << 15 else "long"  # no count is above that of the texts
    pairs = counted.groupBy("c", "w").agg(*[F.sum(x).cast(kind).alias(x) for x in "to"]).toArrow()
    context, word, *counts = (pairs[c].to_numpy() for c in "cwto")
    del pairs
    context, word = context.view(np.uint64), word.view(np.uint64)
    vocabulary = np.unique(np.concatenate((np.unique(context), np.unique(word), [_START])))
    context, word = (np.searchsorted(vocabulary, x).astype(np.int32) for x in (context, word))
    order = np.lexsort((word, context))
    context, word, counts = context[order], word[order], [x[order] for x in counts]
    # Document counts of every word of the corpus; the sample's words keep theirs, the others become one row.
    own = docs.sparkSession.createDataFrame(pa.table({"v": T.signed(vocabulary)}))
    spread = docs.select("text").mapInArrow(_spread, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    known = spread.join(F.broadcast(own), F.col("w") == F.col("v"), "left").groupBy("v").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    rows = docs.count()
    heard, rest, others = np.zeros(len(vocabulary) + 1), 0, 1
    mine = known.filter(known["v"].is_valid())
    heard[np.searchsorted(vocabulary, mine["v"].to_numpy().view(np.uint64))] = mine["n"].to_numpy()
    for r in known.filter(known["v"].is_null()).to_pylist():
        rest, others = r["n"], r["words"] + 1
    # A prior of PRIOR labelled documents per word, in documents of the corpus; the last entry holds all other words together.
    fitted = texts.filter("not calibrate").count()
    more = PRIOR * max(1.0, rows / max(fitted, 1))
    shared = heard + more
    shared[-1] = rest + more * others
    shared /= shared.sum()
    model = Model(vocabulary, shared, context, word, *counts)
    model.sent = docs.sparkSession.sparkContext.broadcast(model)
    sample = _evidence(texts.filter("calibrate").select("text", "toxic"), model).toArrow()
    x = np.column_stack([sample[c].to_numpy() for c in ("whole", "phrase", "peak")])
    y = sample["toxic"].to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        order = np.lexsort((y, *x.T))  # the sums of the fit don't depend on where rows come from
        model.weights = _logistic(x[order], y[order])
    elif len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        model.weights = np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0])
    return model


def _evidence(labelled: DataFrame, model: Model) -> DataFrame:
    sent = model.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch.column(0)):
                e = sent.value.evidence(*tokens(piece))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(piece.first, len(piece)), *map(pa.array, e.T.copy())], names=["toxic", "whole", "phrase", "peak"]
                )

    return labelled.mapInArrow(run, "toxic int, whole double, phrase double, peak double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence, phrase, peak) per row of ``docs``; a text without words has no evidence and the base score."""
    sent, weights = model.sent, model.weights  # the tables went out before the weights were known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch.column(1)):
                e = sent.value.evidence(*tokens(piece))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(piece)), pa.array(probability(e, weights)), *map(pa.array, e.T.copy())],
                    names=["doc_id", "score", "evidence", "phrase", "peak"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence double, phrase double, peak double")


def held_out():
    """Rows that nothing may be learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic, calibrate) of at most ``limit`` labelled rows outside the held-out ones.

    Labels that are NULL or stand at no document are left out; of several labels of a doc_id the largest counts.
    The joined label rows are at most ``limit``, so they are broadcast.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = stage(known.orderBy(order, "doc_id").limit(limit).withColumn("calibrate", F.pmod(order, F.lit(4)) == 0), "labelled")
    chosen = chosen.withColumnRenamed("doc_id", "__id")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "toxic", "calibrate")


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, phrase, peak), one row per row of ``docs``.

    * A null or empty text has no evidence: its score is that of evidence 0.
    * Rows are scored on their own, so repeated rows score alike; a row without doc_id isn't held out and has no label.
    * Other columns of either table are not read. Empty tables give empty results or a constant score.
    """
    model = fit(docs, labelled_sample(docs, labels, limit))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "phrase", "peak"
    )
