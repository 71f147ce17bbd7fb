"""Near-duplicate vectors by randomised-rotation binary codes.

Every usable vector is normalised, rotated by a fixed random rotation and stored once
as the packed signs of its coordinates, with a correction factor: the inner product of
the vector and its own code; and as a query, its rotated coordinates in 8 bits with
their step and their rounding error.  A query times a code, over the factor, is an unbiased estimate
of the inner product; its error is bounded with confidence by a multiple of
sqrt((1 - f*f) / (f*f * (d - 1))), and by the rounding error over the factor.  Pairs whose upper bound
is below the threshold are done; all others get an exact cosine in double
precision, and only that makes a link.

Pairs are looked for in buckets of random hyperplane tables.  Key length grows
with the number of vectors and the number of tables with the key length, so
that a pair right at the threshold is missed with a chance of ``MISS`` at most,
at any size.  Only codes go to the buckets.  A pair counts in the first table in which it
meets, so no pairs are sent anywhere to be told apart.  The whole vectors of those
that are in an open pair of a bucket follow in a second step, where the codes tell
the same pairs again.  A bucket of over ``BUCKET`` vectors is dealt
into blocks, and pairs of blocks are compared in tasks of their own.

Equal vectors form a class first and are compared as one.  Null and zero
vectors and those with null or non-finite components link with nothing, nor do
vectors of different lengths with each other.  Rows with a null id have a null
component and aren't kept, but count as linked vectors.  Repeated rows are
vectors of their own.  An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chomeflow.llm.arrow_text import mix
from chomeflow.llm.components import connected_components
from chomeflow.llm.tables import Scratch

COSINE = 0.9
MISS = 0.02
CONFIDENCE = 3.5
BUCKET = 1024
#: Vectors that a bucket holds on average.
SPREAD = 32


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(31 + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(bits of a key, tables) for n vectors."""
    bits = min(30, max(4, round(math.log2(max(n, 1) / SPREAD + 1))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Each vector's key in each table."""
    planes = np.random.default_rng(37 + x.shape[1]).normal(size=(x.shape[1], bits * tables))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, signs, correction factors) of unit vectors."""
    rotated = x @ rotation(x.shape[1])
    signs = np.where(rotated > 0, 1.0, -1.0)
    return rotated, signs, np.abs(rotated).sum(1) / math.sqrt(x.shape[1])


def _stored(d: int) -> np.dtype:
    """What is stored of a vector of d components: 8 + d/8 + d + 16 bytes."""
    return np.dtype([("factor", "<f8"), ("step", "<f8"), ("error", "<f8"), ("signs", "u1", (d + 7) // 8), ("query", "i1", d)])


def codes(x: np.ndarray) -> np.ndarray:
    """The stored codes of unit vectors."""
    rotated, signs, factors = encode(x)
    out = np.zeros(len(x), _stored(x.shape[1]))
    step = np.maximum(np.abs(rotated).max(1), 1e-300) / 127
    query = np.rint(rotated / step[:, None])
    out["factor"], out["step"], out["query"] = factors, step, query
    out["error"] = np.abs(rotated - query * step[:, None]).sum(1) / math.sqrt(x.shape[1])
    out["signs"] = np.packbits(signs > 0, axis=1)
    return out


def upper_bounds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of inner products of queries (rows) and coded vectors (columns), from codes alone."""
    d = x["query"].shape[1]
    signs = np.unpackbits(y["signs"], axis=1, count=d).astype(np.float32) * 2 - 1
    estimate = (x["query"].astype(np.float32) @ signs.T) * (x["step"][:, None] / (math.sqrt(d) * y["factor"]))
    f = y["factor"]
    return estimate + CONFIDENCE * np.sqrt(np.maximum(1 - f**2, 0)) / (f * math.sqrt(max(d - 1, 1))) + x["error"][:, None] / f


def open_pairs(x: np.ndarray, y: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Which pairs of codes may link, as a matrix."""
    return (upper_bounds(x, y) >= cosine) & (upper_bounds(y, x).T >= cosine)


def _usable(column: pa.Array) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            if not np.isfinite(x).all() or not np.linalg.norm(x) > 0:
                x = None
        out.append(x)
    return out


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        found = _usable(batch.column(1))
        cls = [None if x is None else xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in found]
        unit = [None if x is None else (x / np.linalg.norm(x)).tobytes() for x in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.int64()), pa.array(unit, pa.binary())], ["_id", "cls", "unit"])


def _packed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The bytes of all rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def _dim(size: int) -> int:
    """The number of components of codes of so many bytes."""
    d = max(1, (size - 24) * 8 // 9 - 2)
    while _stored(d).itemsize < size:
        d += 1
    return d


def _by_dim(units: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector."""
    raw = units.to_pylist()
    size = np.array([len(u) for u in raw])
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        yield at, np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """id, n_links, component_id, kept of each row."""
    scratch = Scratch(vectors.sparkSession, "rabitq")
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = scratch.save(vectors.select(id_col, vector_col).mapInArrow(_classes, f"_id {kind}, cls bigint, unit binary"), "vectors")
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.save(classes, "classes")
    bits, tables = plan(classes.count(), cosine)
    units = rows.select("cls", "unit", "_id").join(classes, (rows["cls"] == classes["cls"]) & rows["_id"].eqNullSafe(classes["rep"]), "left_semi")
    units = units.select("cls", "unit").dropDuplicates(["cls"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_dim(batch.column(1)):
                for lo in range(0, len(at), 500):
                    part = batch.take(pa.array(at[lo : lo + 500]))
                    k = keys(x[lo : lo + 500], bits, tables).astype("<u4")
                    code = [c.tobytes() for c in codes(x[lo : lo + 500])]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(code, pa.binary()), pa.array([r.tobytes() for r in k], pa.binary())], ["cls", "unit", "copies", "code", "keys"])

    coded = scratch.save(units.join(classes.select("cls", "copies"), "cls").select("cls", "unit", "copies").mapInArrow(encoded, "cls bigint, unit binary, copies bigint, code binary, keys binary"), "codes")

    def into_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                k = _packed(part.column(3)).view("<u4").reshape(-1, tables)
                size = pc.binary_length(part.column(2)).to_numpy().astype(np.uint64)
                for t in range(tables):
                    bucket = mix(mix(size * np.uint64(tables) + np.uint64(t)) ^ k[:, t])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(np.full(len(k), t, np.int32)), *part.columns], ["bucket", "t", "cls", "copies", "code", "keys"])

    spread = coded.select("cls", "copies", "code", "keys").mapInArrow(into_tables, "bucket bigint, t int, cls bigint, copies bigint, code binary, keys binary")
    counts = spread.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    big = scratch.save(counts.where(F.col("m") > BUCKET), "large-buckets")
    blocks = F.ceil(F.col("m") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("cls", F.lit(9)), blocks).cast("int")
    in_blocks = spread.join(big, "bucket").withColumn("n", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    side = [F.col(c) for c in ("t", "cls", "copies", "code", "keys")]
    in_blocks = in_blocks.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("leaf"), F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), *side)
    small = spread.join(big, "bucket", "left_anti").select(F.col("bucket").alias("leaf"), F.lit(-1).alias("side"), *side)

    def met(rows_: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Of one leaf: the members of both sides, and the open pairs among them that meet in this table first."""
        sides, table = rows_.column("side").to_numpy(), rows_.column("t")[0].as_py()
        inside = sides[0] == -1
        a = np.arange(len(sides)) if inside else np.flatnonzero(sides == 0)
        b = a if inside else np.flatnonzero(sides == 1)
        if not len(a) or not len(b) or inside and len(a) < 2:
            return None
        code = _packed(rows_.column("code")).view(_stored(_dim(len(rows_.column("code")[0].as_py()))))
        k = _packed(rows_.column("keys")).view("<u4").reshape(-1, tables)
        hit = open_pairs(code[a], code[b], cosine)
        if inside:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        i, j = a[i], b[j]
        first = np.ones(len(i), bool)
        for t in range(table):
            first &= k[i, t] != k[j, t]
        return a, b, i[first], j[first]

    def choose(rows_: pa.Table) -> list[pa.RecordBatch]:
        """Of one leaf, the members of open pairs."""
        got = met(rows_)
        if got is None or not len(got[2]):
            return []
        return rows_.take(pa.array(np.unique(np.concatenate(got[2:])))).combine_chunks().to_batches()

    def confirm(rows_: pa.Table) -> list[pa.RecordBatch]:
        """Of one leaf: counts (class, links) and links that join the components."""
        got = met(rows_)
        if got is None or not len(got[2]):
            return []
        _, _, i, j = got
        x = _packed(rows_.column("unit")).view("<f8").reshape(rows_.num_rows, -1)
        hit = np.concatenate([np.einsum("ij,ij->i", x[i[lo : lo + 100_000]], x[j[lo : lo + 100_000]]) >= cosine for lo in range(0, len(i), 100_000)])
        i, j = i[hit], j[hit]
        if not len(i):
            return []
        cls, copies = rows_.column("cls").to_numpy(), rows_.column("copies").to_numpy()
        total = np.zeros(len(cls), np.int64)
        np.add.at(total, i, copies[j])
        np.add.at(total, j, copies[i])
        linked_ = np.flatnonzero(total)
        # a link to the smallest partner for each member, and from there on to its own
        low = np.arange(len(cls))
        while True:
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            if (new == low).all():
                break
            low = new
        joined = np.flatnonzero(low != np.arange(len(cls)))
        c = np.concatenate([cls[linked_], cls[joined]])
        n = pa.array(np.concatenate([total[linked_], np.zeros(len(joined), np.int64)]), mask=np.arange(len(c)) >= len(linked_))
        to = pa.array(np.concatenate([np.zeros(len(linked_), np.int64), cls[low[joined]]]), mask=np.arange(len(c)) < len(linked_))
        return [pa.RecordBatch.from_arrays([pa.array(c), n, to], ["cls", "n", "to"])]

    def leaf_by_leaf(each: Callable[[pa.Table], list[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """``each`` for every leaf of batches that come sorted."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def leaves(table: pa.Table, last: bool) -> tuple[Iterator[pa.RecordBatch], pa.Table]:
                leaf = table.column("leaf").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
                stop = len(edges) - 1 if last else len(edges) - 2
                found = [x for a, b in zip(edges[:stop], edges[1 : stop + 1], strict=True) if b - a > 1 for x in each(table.slice(a, b - a))]
                joined = pa.Table.from_batches(found).combine_chunks().to_batches() if found else []
                return joined, table.slice(edges[stop])

            for batch in batches:
                for lo in range(0, batch.num_rows, 4000):
                    held.append(batch.slice(lo, 4000))
                    if held[0].column(0)[0] != held[-1].column(0)[-1]:
                        found, rest = leaves(pa.Table.from_batches(held), last=False)
                        held = rest.to_batches()
                        yield from found
            if held:
                yield from leaves(pa.Table.from_batches(held), last=True)[0]

        return run

    in_leaf = "leaf bigint, side int, t int, cls bigint, copies bigint, code binary, keys binary"
    at = small.unionByName(in_blocks).repartition("leaf").sortWithinPartitions("leaf", "side", "cls")
    chosen = scratch.save(at.mapInArrow(leaf_by_leaf(choose), in_leaf).select("leaf", "side", "t", "cls"), "open")
    whole = chosen.join(coded, "cls").select("leaf", "side", "t", "cls", "copies", "code", "keys", "unit").repartition("leaf").sortWithinPartitions("leaf", "side", "cls")
    found = scratch.save(whole.mapInArrow(leaf_by_leaf(confirm), "cls bigint, n bigint, to bigint"), "found")
    comps = connected_components(found.where("to IS NOT NULL").select(F.col("cls").alias("_a"), F.col("to").alias("_b")), scratch)
    linked = found.where("n IS NOT NULL").groupBy("cls").agg(F.sum("n").alias("n"))
    rooted = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").join(linked, "cls", "left")
    rooted = scratch.save(rooted.select("cls", "rep", F.coalesce("comp", "cls").alias("comp"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "rooted")
    least = scratch.save(rooted.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
    of_class = scratch.save(rooted.join(least, "comp").select("cls", "n_links", "component_id"), "of-class")
    scratch.drop(coded, big, chosen, found, rooted, least)
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return (
        rows.select("_id", "cls")
        .join(of_class, "cls", "left")
        .select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
    )
