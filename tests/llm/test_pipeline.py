import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chomeflow.llm import queries
from tests.llm.cases import DOCS, documents, no_documents, texts
from tests.llm.test_operators import _components, _words

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def _shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now, n = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns and now.count() <= n, name
        n = now.count()
    texts = [r["text"] for r in now.collect()]
    assert not any(b in t for b in benchmark for t in texts)
    assert len(set(texts)) == len(texts)
    before = {m for r in docs.collect() for m in re.findall(r"[\w.]+@[\w.]+\w|\b\d{16}\b", r["text"] or "")}
    assert not any(m in t for m in before for t in texts)
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert last.count() == n and [s for s, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "bpe"]


def test_kept_rows_against_brute_force(spark):
    """Near copies and benchmark items, each stage on the whole table of the smallest size."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: _shingles(_words(t)) or ({tuple(_words(t))} if _words(t) else set()) for i, t in rows.items()}
    ids = sorted(rows)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comps = _components(ids, pairs)
    got = {r["doc_id"] for r in STAGES["near_dedup"](spark, docs, SF).collect()}
    assert got == {i for i in ids if comps[i] == i} and len(got) < len(ids)

    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    items = [_shingles(plain(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i: _shingles(plain(t)) for i, t in rows.items()}
    bad = {i for i in ids for q in items if q and 4 * len(q & held[i]) >= 3 * len(q)}
    got = {r["doc_id"] for r in STAGES["decontamination"](spark, docs, SF).collect()}
    assert got == set(ids) - bad and bad


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows(spark, name):
    """Nulls, empty and long texts, repeated rows, rows that share an id or have none, clashing columns, an empty table."""
    extra = [(3, "another text of the same id with words of its own", "x", None, "y"), (None, None, None, None, None), (None, texts()[6], "x", None, None)]
    docs = documents(spark).unionByName(spark.createDataFrame(extra, DOCS)).withColumns({"score": F.lit("s"), "kept": F.lit(1), "n": F.lit(2.0), "rep": F.lit(None).cast("int")})
    out = STAGES[name](spark, docs, SF)
    rows, before = out.collect(), docs.count()
    if name == "bpe":
        assert len(rows) == before and all(r["n_tokens"] == len(r["ids"]) for r in rows)
        return
    assert out.columns == docs.columns
    if name == "pii":
        assert len(rows) == before
    if name in ("decontamination", "pii"):
        assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))
    if name == "near_dedup":
        left = [r["text"] for r in rows]
        # of the repeated row one is left; empty sets link with nothing, and the text without an id stays
        assert len(left) < before and {" ".join(_words(t)) for t in left} >= {"another text of the same id with words of its own", "a row without an id but with quite some words"}
        assert sum(not _words(t) for t in left) == sum(not _words(r["text"]) for r in docs.collect())
        full = [tuple(_words(t)) for t in left if _words(t)]
        assert len(set(full)) == len(full)
    none = no_documents(spark)
    assert STAGES[name](spark, none, SF).count() == 0 and STAGES[name](spark, none, SF).columns == none.columns


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()) == list(range(1, 14))
