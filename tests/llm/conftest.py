import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and a river stone light under over small great house tree cloud morning evening walk run sing call river-bank North 12 é".split()

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *[T.StructField(n, T.StringType()) for n in ("gone", "hits", "carry", "x", "node", "component", "size", "score", "shard", "run", "h")],
])


def frame(spark, rows):
    """Rows (doc_id, text) as documents with extra, clashing columns."""
    full = [(d, t, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, len(t) if t else None, *["?"] * 11) for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Hard cases: nulls, empty and blank texts, repeated rows, equal and nearly
    equal texts, one doc_id with two texts, a shared passage, a long text."""
    rng = random.Random(5)
    base = prose(rng, 160)
    passage = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n\t \r"), (4, "one two three"), (5, "One  TWO three"), (6, "x" * 5000)]
    rows += [(10 + k, base) for k in range(7)]
    for k in range(12):
        words = base.split(" ")
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        rows.append((20 + k, " ".join(words)))
    rows += [(40 + k, prose(rng, rng.randrange(5, 80)) + " " + passage + "\n" + prose(rng, rng.randrange(5, 80))) for k in range(9)]
    rows += [(60 + k, "\n".join(prose(rng, rng.randrange(1, 12)) for _ in range(6))) for k in range(15)]
    line = "This Line is long enough to be looked at, and common."
    rows += [(80 + k, f"{prose(rng, 5)}\n  {line.upper() if k % 2 else line}\t\n{prose(rng, 3)}\n{line}") for k in range(7)]
    long = prose(rng, 20_000)
    rows += [(90, long), (91, long[: len(long) // 2]), (92, "Übung über ß İstanbul ΑΣ 日本語 " * 30), (93, "<|endoftext|> a<|startoftext|>b")]
    rows += [(95, "repeated row of a few words " * 9)] * 3 + [(96, prose(rng, 50)), (96, prose(rng, 50))]
    return rows
