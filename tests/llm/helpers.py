"""Small tables with the awkward rows that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["batch", "h1", "n_words", "items", "spans", "row", "key", "part", "component", "v", "k", "size", "__none"]


def documents(spark, rows, extra=False):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        for i, name in enumerate(CLASHING):
            df = df.withColumn(name, df["doc_id"].cast("string") if i % 2 else df["n_chars"])
    return df


def words(rng: random.Random, n: int, pool: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def odd_rows():
    """Null and empty texts, blanks, a very long text, a repeated row, a row without doc_id."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    return [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "one two"), (5, "one two"), (None, "one two three four five six"), (6, "é ñ " * 30)]
