"""Small tables that every operator is run on."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, _id string, cls string, node string"


def texts() -> list[str | None]:
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = sentence(120)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (3, 60, 110)]
    passage = sentence(60)
    held = [f"{sentence(40)} {passage} {sentence(30)}" for _ in range(3)]
    odd = [None, "", " \t\n ", "one", "two words", "one two three four five", "ＦＵＬＬ　width text", "A" * 50_000, sentence(3_000)]
    return [base, base, base.upper(), *near, *held, *odd, *[sentence(r.randint(1, 90)) for _ in range(30)]]


def documents(spark: SparkSession, extra: list[str] = ()) -> DataFrame:
    """Copies, near copies, shared passages, nulls, empty and long texts, a null id, a repeated row, clashing column names."""
    rows = [(i, t, "x", None, "y") for i, t in enumerate([*texts(), *extra])]
    rows += [rows[0], (None, "a row without an id but with quite some words", None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
