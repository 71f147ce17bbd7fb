"""Benchmark decontamination: size-partitioned MinHash containment search, in SQL functions only.

Texts are normalised (lower case, runs of other characters than letters and
digits one space) and cut into shingles of 5 words.  An item has ``HASHES`` minwise
functions, each a hash of its own of the shingle's hash.  Items are partitioned by
size: class W holds items of W/2 (not included) to W shingles.  For each class
that occurs, documents are cut into windows of W/2 shingles, however long the
document is, and each window has its minwise values.  A passage equal to an
item fills at least a window's length; the shingle with the item's least value lies in
some window, and is the least there too unless a foreign shingle at the passage's
ends is less, so each value agrees with a chance of about one half, and one of all
agrees with a chance over 0.9999 (over 0.999 for an item of which three quarters are
there).  Windows of larger classes take their minima from those of smaller ones.

The index of items' keys is broadcast if it has ``INDEX_ROWS`` rows at most; a larger one
is joined by a shuffle of the documents' keys.  Either way documents are read once for it.  Every
candidate is verified: the share of the item's distinct shingles that the whole
document has, compared as text, must be ``CONTAINMENT`` or more.

Null and empty texts and texts of fewer than five words have no shingles: such
items are found nowhere, such documents hold nothing.  Rows with a null id
aren't reported, but ``decontaminated`` judges them and tells rows of one id apart.  Rows of one id count as one document, or item.  Repeated rows
and other columns change nothing.  Long texts are read as a whole.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chomeflow.llm.tables import Scratch, bounded, free_name

SHINGLE = 5
CONTAINMENT = 0.75
HASHES = 16
INDEX_ROWS = 500_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use).getItem(0)


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _places(w: Column, each: Callable[[Column], Column], kind: str) -> Column:
    """An array with ``each(i)`` for the start i of every shingle."""
    n = F.size(w) - SHINGLE
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.when(n >= 0, n).otherwise(0)), each)).otherwise(F.array().cast(f"array<{kind}>"))


def shingle_hashes(w: Column) -> Column:
    return _places(w, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]), "bigint")


def shingle_texts(w: Column) -> Column:
    return _places(w, lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " "), "string")


# Filters on computed columns are pushed below them, where Spark writes the column's
# whole expression into lambdas; ``let`` keeps the words computed once.
def text_hashes(text: Column) -> Column:
    return let(words(text), shingle_hashes)


def text_shingles(text: Column) -> Column:
    return let(words(text), shingle_texts)


def _functions(each: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(HASHES)), each)


def minwise(hashes: Column) -> Column:
    """The HASHES minwise values of an array of hashes."""
    return _functions(lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def _salt(size_class: int) -> int:
    return (size_class * 0x9E3779B97F4A7C15) % (1 << 62)


def window_keys(hashes: Column, classes: list[int]) -> Column:
    """Keys of all windows of all size classes of a document: minwise values, told apart by class."""
    base = max(1, min(classes) // 2)

    def salted(blocks: Column, w: int) -> Column:
        return F.transform(F.flatten(blocks), lambda v: v.bitwiseXOR(F.lit(_salt(w))))

    def paired(blocks: Column) -> Column:
        """Minima of windows twice as long."""
        starts = F.sequence(F.lit(0), F.size(blocks) - 1, F.lit(2))
        least = lambda x, y: F.least(x, F.coalesce(y, x))
        return F.transform(starts, lambda s: F.when(F.get(blocks, s + 1).isNull(), F.get(blocks, s)).otherwise(F.zip_with(F.get(blocks, s), F.get(blocks, s + 1), least)))

    def from_size(blocks: Column, size: int) -> Column:
        """Keys of the classes whose windows have ``size`` shingles or more."""
        own = [salted(blocks, w) for w in classes if max(1, w // 2) == size]
        if not any(w // 2 > size for w in classes):
            return F.concat(*own)
        return F.concat(*own, let(paired(blocks), lambda more: from_size(more, 2 * size)))

    n_blocks = F.ceil(F.size(hashes) / base).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: let(F.slice(hashes, b * base + 1, base), minwise))
    return F.when(F.size(hashes) > 0, let(blocks, lambda least: from_size(least, base))).otherwise(F.array().cast("array<bigint>"))


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT
) -> DataFrame:
    """doc id, item id, shared, item_shingles, containment of each item found in each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    d = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).where("_doc IS NOT NULL")
    q = items.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text")).where("_item IS NOT NULL")

    parts = q.select("_item", F.explode(text_shingles(F.col("_text"))).alias("shingle")).distinct()
    parts = scratch.save(parts, "item-shingles")
    sizes = parts.groupBy("_item").agg(F.count("*").alias("n"))
    size_class = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")
    c = F.col("c")
    hashed = q.select("_item", text_hashes(F.col("_text")).alias("h")).join(sizes, "_item").select("_item", size_class.alias("c"), "h")
    signed = scratch.save(hashed.select("_item", "c", minwise(F.col("h")).alias("m")), "item-minima")
    classes = sorted(r[0] for r in signed.select("c").distinct().collect())  # at most 32 powers of two
    salt = F.try_element_at(F.create_map(*[F.lit(x) for w in classes for x in (w, _salt(w))]), c) if classes else F.lit(0).cast("bigint")
    index = scratch.save(signed.select("_item", F.explode(F.transform("m", lambda v: v.bitwiseXOR(salt))).alias("key")).distinct(), "index")

    def probe(hashes: Column) -> Column:
        return F.array_distinct(window_keys(hashes, classes)) if classes else F.array().cast("array<bigint>")

    probes = d.select("_doc", F.explode(let(text_hashes(F.col("_text")), probe)).alias("key"))
    small = index.count() <= INDEX_ROWS
    pairs = scratch.save(probes.join(F.broadcast(index) if small else index, "key").select("_doc", "_item").distinct(), "candidates")

    some = scratch.save(pairs.select("_doc").distinct(), "candidate-documents")
    texts = d.join(bounded(some), "_doc", "left_semi")
    held = texts.select("_doc", F.explode(text_shingles(F.col("_text"))).alias("shingle")).distinct()
    wanted = pairs.join(parts, "_item")
    shared = wanted.join(held, ["_doc", "shingle"]).groupBy("_doc", "_item").agg(F.count("*").alias("shared"))
    shared = scratch.save(shared, "shared")
    ratio = F.col("shared").cast("double") / F.col("n")
    out = shared.join(scratch.save(sizes, "sizes"), "_item").where(ratio >= containment)
    scratch.drop(pairs, some)
    return out.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), "shared", F.col("n").alias("item_shingles"), ratio.alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns.

    Rows are told apart by id and text, so rows without an id or with a repeated one
    are judged by their own text.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    names = [free_name(docs, f"_k{i}") for i in range(3)]
    marked = docs.withColumns(dict(zip(names, [F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), F.xxhash64(text_col)], strict=True)))
    key = free_name(marked, "_key")
    keyed = marked.select(F.struct(*names).alias(key), text_col)
    bad = contained_items(keyed, items, key, text_col).select(key).distinct().select(*(F.col(key)[c].alias(c) for c in names))
    return marked.join(bounded(scratch.save(bad, "bad")), names, "left_anti").select(*docs.columns)
