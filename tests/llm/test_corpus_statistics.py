"""Importance resampling, the filter audit and token counts against plain Python."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from chomeflow.llm import filter_audit, importance_crc, token_count
from chomeflow.llm.queries import tokenizer_path
from tests.llm.cases import documents, no_documents

# --- 11 ------------------------------------------------------------------------------------------


def _features(text, order, size):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(x.encode()) % size for x in runs)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_ring_emits_every_run_of_words(order):
    r = random.Random(order)
    for n in (0, 1, 2, 3, 50):
        text = r.choice(["", "\n", "!"]).join(r.choice(["Ab", "été", "x1", "É", "ﬁ_b", "a-b", " ", "\x7f"]) + r.choice([" ", ".", "", "\n"]) for _ in range(n))
        words, want = _features(text, order, 97)
        got = importance_crc.feature_buckets(text, order, 97)
        assert (got[0], dict(zip(got[1].tolist(), got[2].tolist(), strict=True))) == (words, dict(want))


def test_ring_crosses_the_runs_of_a_long_text(monkeypatch):
    monkeypatch.setattr(importance_crc, "word_runs", lambda data, table: importance_crc.__dict__["_runs"](data, table, 7))
    from chomeflow.llm.arrow_text import word_runs

    monkeypatch.setattr(importance_crc, "_runs", word_runs, raising=False)
    text = "Lorem ipsum dolor-sit  amet, consectetur a b c d" * 5
    words, want = _features(text, 3, 50)
    got = importance_crc.feature_buckets(text, 3, 50)
    assert (got[0], dict(zip(got[1].tolist(), got[2].tolist(), strict=True))) == (words, dict(want))


def _resampled(rows, target, order, size, least, percent):
    found = [_features(t, order, size) for _, t in rows]
    s, t = Counter(), Counter()
    for _, c in found:
        s.update(c)
    for x in target:
        t.update(_features(x, order, size)[1])
    ns, nt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + size) / ((s[b] + 1.0) * (nt + size)))) for b in range(size)}
    out = []
    for i, (words, c) in zip([i for i, _ in rows], found, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in c.items())
        out.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    may = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(may[: percent * len(may) // 100]):
        x[4] = k + 1
    return [tuple(x[:5]) for x in out]


@pytest.mark.parametrize("order,size,percent", [(1, 10_000, 10), (2, 61, 55)])
def test_resampling_against_plain_python(spark, order, size, percent):
    docs = documents(spark, ["a b c " * 30, "ÄÖ a1 " * 25])
    target = spark.createDataFrame([(1, "w1 w2 w3 w1 changed"), (2, None), (3, ""), (3, "W1")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = importance_crc.resampled(docs, target, order=order, n_buckets=size, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = _resampled(rows, [r["text"] for r in target.collect()], order, size, 20, percent)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert any(x[4] for x in want)


def test_resampling_of_ties_takes_the_smaller_id(spark):
    text = " ".join(["same"] * 30)
    docs = spark.createDataFrame([(7, text)] * 40 + [(3, text)] * 2 + [(None, text)], "doc_id long, text string").repartition(4)
    got = importance_crc.resampled(docs, docs.limit(0), percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 44))
    by = {i: [r["rank"] for r in got if r["doc_id"] == i] for i in (7, 3, None)}
    assert max(by[7]) - min(by[7]) == 39 and max(by[3]) - min(by[3]) == 1


def test_resampling_of_nothing(spark):
    assert importance_crc.resampled(no_documents(spark), no_documents(spark)).count() == 0
    assert importance_crc.resampled(documents(spark), no_documents(spark)).where("rank IS NOT NULL").count() > 0


def test_resampling_prefers_the_target(spark):
    docs = [(i, " ".join(random.Random(i).choice(["law", "court", "judge"] if i % 4 == 0 else ["goal", "ball", "team"]) for _ in range(40))) for i in range(200)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = importance_crc.resampled(docs, spark.createDataFrame([("court judge law " * 50,)], "text string"), percent=20).where("rank IS NOT NULL").collect()
    assert len(got) == 40 and all(r["doc_id"] % 4 == 0 for r in got)


# --- 12 ------------------------------------------------------------------------------------------


def _audit(rows, labels):
    """Every order applied to every document, one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = set()
        f |= {"A"} if len(words) < 100 else set()
        f |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        f |= {"E"} if i is not None and least[text] < i else set()
        fails.append((part or "", f, i in good, i in toxic))
    out, shapley = {}, Counter()
    for p in {x[0] for x in fails}:
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                c = [0] * 6
                for part, f, g, t in fails:
                    if part != p:
                        continue
                    gone, bad = bool(f & set(order[:k])), x in f
                    c[0] += not gone and not bad
                    c[1] += not gone and bad
                    c[2] += gone and bad
                    c[3] += f == {x}
                    c[4] += not gone and bad and g
                    c[5] += not gone and bad and t
                out[p, "".join(order), k + 1] = c
                shapley[p, x] += c[1]
    return sorted((*k, *c, shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items())


def _parts(spark):
    docs = documents(spark, ["UPPER lower " * 60, "one & two", "x " * 99 + "y", " ".join(f"v{i}" for i in range(100))] * 3)
    return docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "de"))


def test_audit_against_plain_python(spark):
    docs = _parts(spark)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(3, 0, 1), (None, 1, 1), (4, None, None)]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = _audit(rows, labels)
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert all(sum(r[c] for r in want) for c in range(3, 10)) and {r[0] for r in want} == {"", "de", "en"}


def test_audit_of_copies_and_null_ids(spark):
    rows = [(i, "copy", "en") for i in (5, 5, 7, 9)] + [(None, "copy", "en"), (2, None, None), (3, "", None), (None, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in filter_audit.filter_audit(docs, no_labels).collect()) == _audit(rows, [])


def test_audit_has_80_edges_a_part(spark):
    classes = spark.createDataFrame([("en", m, False, True, 1) for m in range(32)], "part string, mask int, good boolean, toxic boolean, n long")
    edges = filter_audit.lattice_edges(classes).collect()
    assert len(edges) == 80 and all(r["kept"] + r["removed"] == 32 >> bin(r["applied"]).count("1") for r in edges)
    assert filter_audit.permutation_steps(spark).count() == 600


def test_audit_of_nothing(spark):
    docs = no_documents(spark).withColumn("lang", F.lit("en"))
    assert filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- 13 ------------------------------------------------------------------------------------------

ODD = [
    "a", "b", "the", " ", "  ", " ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "'s", "'", "l", "1", "23", "!", "?", "é", "中", "ا", "☃", "<|endoftext|>",
    "<|endof", "text|>", " ", "　", "́", "Я", "на", "'ll", "ﬀ", "𐀀", "😀", " '", "ԯ", "ʰ", "\x00", "가", "々",
]


@pytest.fixture(scope="module")
def counter():
    return token_count.TokenCounter(tokenizer_path(), token_count.whole_tokens(tokenizer_path()))


@functools.cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def _library(text):
    return len(_tokenizer().encode(text, add_special_tokens=False))


def test_counts_are_those_of_the_library(counter):
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 14)))
        assert counter.count(text) == _library(text), repr(text)


def test_counts_of_long_texts_are_read_in_pieces(counter, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(token_count, "PIECE", 50)
    monkeypatch.setattr(token_count, "KEPT", 20)
    for _ in range(50):
        text = "".join(r.choice(ODD + ["word ", "more "]) for _ in range(300))
        assert counter.count(text) == _library(text)


def test_settled_characters_split_as_in_the_library(counter):
    pattern = token_count._PRETOKEN
    for c in map(chr, (*range(0x530), *range(0x2010, 0x2028), 0x20AC, *range(0x3000, 0x9FF0, 7), *range(0xAC00, 0xD7A4, 7))):
        if token_count._SETTLED.fullmatch(c):
            text = f"a{c}a 1{c}1 !{c}!  {c} x"
            assert [text[a:b] for _, (a, b) in counter.tok.pre_tokenizer.pre_tokenize_str(text)] == pattern.findall(text), hex(ord(c))


def test_whole_tokens_are_proved(counter):
    whole = token_count.whole_tokens(tokenizer_path())
    assert len(whole) == len(set(whole)) > 49_000 and " the" in counter.whole and "the" in counter.spaced
    assert all(_library(s) == 1 for s in random.Random(5).sample(whole, 500))
    assert counter.fast is not None


def test_merges_by_the_library_where_the_proof_fails():
    half = token_count.TokenCounter(tokenizer_path(), [" the", "a"])
    assert half.fast is None
    for text in ("the cat sat on a mat", "Zürich, 1848!", "a  the the"):
        assert half.count(text) == _library(text)


def test_token_counts_of_odd_rows(spark):
    docs = documents(spark, ["<|endoftext|>", "é " * 1024, "x" * 3000])
    got = token_count.token_counts(docs, tokenizer_path())
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := _library(r["text"] or ""), n > 1024) for r in docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert token_count.token_counts(no_documents(spark), tokenizer_path()).count() == 0
