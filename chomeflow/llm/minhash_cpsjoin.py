"""Near-duplicate documents by chosen-path set similarity join.

A document's set is its distinct 5-word shingles (as 64-bit hashes of words with
A-Z lowered; of fewer words, the whole sequence is the one shingle).  Documents
of equal sets form a class at once; the join works on classes.

Each of ``TREES`` independent trees starts with all classes in its root.  A node
selects one or two of the ``HASHES`` minwise functions (4/3 on average, the
inverse of the similarity looked for), and its classes go on to a child for each
selected function and minwise token.  A pair of similarity s shares a child with
chance s for each function, so pairs at the threshold or over it live on while
others die out.  Nodes of at most ``LEAF`` classes are compared exhaustively, by
minwise signatures; equal nodes of several trees once.  With 10 trees a pair at
0.75 is met with a chance over 0.99 at any depth up to ``DEPTH``, and over 0.999 up to 4.  Tokens have 32 bits
in the roots, where a node holds everything, and 16 below.

A node larger than a leaf branches on as long as it is at most ``SHRINK`` of its parent; one that
hardly shrinks holds classes that are much alike and is dense, as are those of ``DEPTH``.

Signature estimates are ``SLACK`` looser than the threshold (over three standard
deviations).  A leaf of m classes gives a spanning forest of its candidates, so m - 1
links at most, not m * m; the components of these links are families, which
hold every candidate pair.  Each family's full sets then meet in one block,
where links are confirmed exactly, best candidates first and only between
classes that aren't joined yet.

A family of more than ``FAMILY`` classes or ``SHINGLES`` shingles is dealt into
blocks that all hold the same hub classes, so its members meet through the hubs.
A dense node is dealt into leaves with hubs in the same way.  Hubs alone don't join everything: the leaves of large families and the
dense nodes that hold classes of several components after that are compared
in full.  Such a node is dealt into blocks and every two of them meet, but for two of
one same component; classes with a candidate of another component are confirmed
there on full sets.  So every candidate pair of a node is compared or joined already.

Null and empty texts have an empty set and link with nothing.  Rows with a null id
have a null component and aren't kept.  Repeated rows are of one class; each is
returned.  Other columns are ignored.  A long text is read as a whole; what it needs grows with
its words.  An empty table gives none.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chomeflow.llm.arrow_text import blocks, mix, randoms, released, shingle_sets, word_hashes
from chomeflow.llm.components import connected_components
from chomeflow.llm.tables import Scratch, bounded, free_name

SHINGLE = 5
PERCENT = 75
TREES = 10
HASHES = 128
LEAF = 256
DEPTH = 8
SHRINK = 0.7
SLACK = 0.13
FAMILY = 2048
SHINGLES = 8_000_000
HUBS = 64
#: Classes of a block, when a node or family is compared in full.
BLOCK = 1024

_MUL, _ADD = randoms(101, HASHES), randoms(103, HASHES)


def signature(s: np.ndarray) -> np.ndarray:
    """Minwise values of a set under HASHES multiply-shift functions."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(s), 512):
            h = (s[lo : lo + 512, None] * _MUL + _ADD) >> np.uint64(32)
            np.minimum(out, h.min(0).astype(np.uint32), out=out)
    return out


def class_of(s: np.ndarray) -> int:
    """A 64-bit hash of a whole set."""
    with np.errstate(over="ignore"):
        h = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(s))
        return int(mix(np.array([h], np.uint64)).view(np.int64)[0])


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, off in blocks(column):
        yield from shingle_sets(*word_hashes(data, off), SHINGLE)


def branch(nodes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of each row's moves from its node."""
    with np.errstate(over="ignore"):
        coin = mix(nodes ^ np.uint64(0x2545F4914F6CDD1D))
        rows, out = [], []
        for j in range(2):
            at = np.arange(len(nodes)) if j == 0 else np.flatnonzero(coin % np.uint64(3) == 0)
            own = nodes[at]
            which = (mix(own + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))) % np.uint64(HASHES)).astype(np.int64)
            token = sigs[at, which].astype(np.uint64) | (which.astype(np.uint64) << np.uint64(32))
            rows.append(at)
            out.append(mix(own * np.uint64(0xD1342543DE82EF95) + mix(token + np.uint64(j + 1))))
    return np.concatenate(rows), np.concatenate(out)


def root_keys(sigs: np.ndarray) -> np.ndarray:
    """The first nodes of each row in all trees; a column is one function of one tree."""
    out = []
    for node in randoms(107, TREES):
        _, child = branch(np.full(len(sigs), node), sigs)
        out.append(child.view(np.int64).reshape(-1, len(sigs)))
    return np.concatenate(out).T


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _candidates(size: np.ndarray, sigs: np.ndarray, comp: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ends of pairs that may link, most agreeing minwise values first; with ``comp``, of different components and sides (a side under 0 is all)."""
    least = (PERCENT / 100 - SLACK) * HASHES
    none = np.zeros(0, np.int32)
    agree, first, second = [none], [none], [none]
    for i in range(len(size) - 1):
        same = (sigs[i + 1 :] == sigs[i]).sum(1)
        lo, hi = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
        may = (same >= least) & (100 * lo >= PERCENT * hi)
        if comp is not None:
            may &= (comp[i + 1 :] != comp[i]) & ((side[i + 1 :] != side[i]) | (side[i] < 0))
        at = np.flatnonzero(may).astype(np.int32)
        agree.append(same[at].astype(np.int32))
        first.append(np.full(len(at), i, np.int32))
        second.append(at + np.int32(i + 1))
    order = np.argsort(-np.concatenate(agree), kind="stable")
    return np.concatenate(first)[order], np.concatenate(second)[order]


def _forest(pairs: tuple[np.ndarray, np.ndarray], union: _Union, sure: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Of pairs in order, those that join two trees and are sure."""
    for lo in range(0, len(pairs[0]), 10_000):
        for i, j in zip(pairs[0][lo : lo + 10_000].tolist(), pairs[1][lo : lo + 10_000].tolist(), strict=True):
            if union.find(i) != union.find(j) and sure(i, j):
                union.join(i, j)
                yield i, j
        if union.trees == 1:
            return


class _Union:
    def __init__(self, n: int):
        self.root = list(range(n))
        self.trees = n

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[x] = y
        self.trees -= x != y
        return x != y


def leaf_links(cls: np.ndarray, size: np.ndarray, sigs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a leaf's candidate pairs."""
    return [(int(cls[i]), int(cls[j])) for i, j in _forest(_candidates(size, sigs), _Union(len(cls)), lambda i, j: True)]


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two full sets are similar enough, exactly."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def block_links(cls: np.ndarray, sets: list[np.ndarray], comp: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of a block's links, confirmed on full sets; with ``comp``, of those between components."""
    size = np.array([len(x) for x in sets])
    union = _Union(len(cls))
    if comp is not None:
        first: dict[int, int] = {}
        for i, c in enumerate(comp.tolist()):
            union.join(i, first.setdefault(c, i))
    pairs = _candidates(size, np.stack([signature(x) for x in sets]), comp, side)
    return [(int(cls[i]), int(cls[j])) for i, j in _forest(pairs, union, lambda i, j: linked(sets[i], sets[j]))]


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, cls, sig, keys of each row; the last three are null for empty sets."""
    kind = docs.schema[id_col].dataType.simpleString()
    types = {"n_shingles": pa.int64(), "cls": pa.int64(), "sig": pa.binary(), "keys": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = list(_sets(part.column(1)))
                n = [len(s) for s in sets]
                cls = [class_of(s) if len(s) else None for s in sets]
                full = np.stack([signature(s) for s in sets])
                sig = [row.tobytes() if k else None for k, row in zip(n, full.astype(np.uint16), strict=True)]
                keys = [row if k else None for k, row in zip(n, root_keys(full), strict=True)]
                made = [pa.array(x, kind) for x, kind in zip((n, cls, sig, keys), types.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["_id", *types])

    return docs.select(id_col, text_col).mapInArrow(run, f"_id {kind}, n_shingles bigint, cls bigint, sig binary, keys array<bigint>")


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of node, cls, sig, m: the children, with their parent's m."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4000):
            part = batch.slice(lo, 4000)
            cls, m = part.column(1).to_numpy(), part.column(3).to_numpy()
            rows, child = branch(part.column(0).to_numpy().view(np.uint64), _matrix(part.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(cls[rows]), pa.array(m[rows])], ["node", "cls", "of"])


def _grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.Table]]:
    """Tables of whole groups, by the first column; batches come sorted and a group may go on in the next."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        keys = table.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        stop = len(edges) - 1 if last else len(edges) - 2
        return [table.slice(a, b - a) for a, b in zip(edges[:stop], edges[1 : stop + 1], strict=True) if b - a > 1], table.slice(edges[stop])

    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            held.append(batch.slice(lo, rows))
            if held[0].column(0)[0] != held[-1].column(0)[-1]:
                groups, rest = cut(pa.Table.from_batches(held), last=False)
                held = rest.to_batches()
                yield groups
    if held:
        yield cut(pa.Table.from_batches(held), last=True)[0]


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    lo, hi = [min(x) for x in pairs], [max(x) for x in pairs]
    return pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["_a", "_b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: group, cls, size, signature."""
    for groups in _grouped(batches, 2000):
        pairs = []
        for g in groups:
            pairs += leaf_links(g.column(1).to_numpy(), g.column(2).to_numpy(), _matrix(g.column(3)))
        yield _links(pairs)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of columns group, cls, component, side, size and signature, the first four of classes with a candidate of another component."""
    for groups in _grouped(batches, 2000):
        for g in groups:
            found = np.unique(np.concatenate(_candidates(g.column(4).to_numpy(), _matrix(g.column(5)), g.column(2).to_numpy(), g.column(3).to_numpy())))
            if len(found):
                yield from g.select([0, 1, 2, 3]).take(pa.array(found.astype(np.int64))).combine_chunks().to_batches()


def _confirm_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: block, cls, set and maybe component and side."""
    for groups in _grouped(batches, 200):
        pairs = []
        for g in groups:
            labels = [g.column(k).to_numpy() for k in range(3, g.num_columns)]
            pairs += block_links(g.column(1).to_numpy(), [np.frombuffer(x, np.uint64) for x in g.column(2).to_pylist()], *labels)
        yield _links(pairs)


LINKS = "_a bigint, _b bigint"


def _compared(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links to confirm, from (gid, cls) of leaves."""
    rows = members.join(classes.select("cls", "n_shingles", "sig"), "cls").select("gid", "cls", "n_shingles", "sig")
    return rows.repartition("gid").sortWithinPartitions("gid", "cls").mapInArrow(_compare, LINKS).distinct()


def _dealt(rows: DataFrame, group: str, chunks: Column, share: Column) -> DataFrame:
    """(gid, cls): each group dealt into chunks; the ``share`` of its classes that are hubs are in all of them."""
    hub = F.pmod(F.xxhash64("cls", group, F.lit(4)), F.lit(1 << 30)) < share * (1 << 30)
    own = F.pmod(F.xxhash64("cls", group, F.lit(3)), chunks).cast("int")
    where = F.when(hub, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))
    return rows.select(group, "cls", F.explode(where).alias("chunk")).select(F.xxhash64(group, "chunk").alias("gid"), "cls")


def _unjoined(nodes: DataFrame, comps: DataFrame, sigs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(gid, cls, comp, side): classes of nodes (node, cls) with candidates of other components, by pairs of blocks; None if every node is joined."""
    labelled = nodes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("node", "cls", F.coalesce("comp", "cls").alias("comp"))
    # nodes of several components; equal ones once
    marks = [F.count("*").alias("c"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(8))).alias("y")]
    several = labelled.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *marks).where("lo <> hi").groupBy("c", "x", "y").agg(F.min("node").alias("node"))
    rows = scratch.save(labelled.join(several.select("node"), "node", "left_semi").join(sigs.select("cls", "n_shingles", "sig"), "cls"), "several")
    if rows.isEmpty():
        return None

    def pieces(count: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles / (SHINGLES // 4))).cast("int")

    # a component of more than a block has blocks of its own, the others share blocks
    parts = rows.groupBy("node", "comp").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("t")).withColumn("own", pieces(F.col("c"), F.col("t")))
    shared = parts.where("own = 1").groupBy("node").agg(pieces(F.sum("c"), F.sum("t")).alias("shared"))
    pure = F.when(F.col("own") > 1, F.col("comp"))
    block = F.when(F.col("own") > 1, F.xxhash64("node", "comp", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("own")))).otherwise(F.xxhash64("node", F.pmod(F.xxhash64("comp", F.lit(6)), F.col("shared"))))
    placed = rows.join(parts.select("node", "comp", "own"), ["node", "comp"]).join(shared, "node", "left").select("node", "cls", "comp", "n_shingles", "sig", pure.alias("pure"), block.alias("block"))
    placed = scratch.save(placed, "placed")
    blocks_ = placed.select("node", "block", "pure").distinct()
    other = blocks_.select("node", F.col("block").alias("block2"), F.col("pure").alias("pure2"))
    two = blocks_.join(other, "node").where("block < block2 AND NOT coalesce(pure = pure2, false)").select(F.xxhash64("block", "block2").alias("gid"), "block", "block2")
    deal = two.select("gid", "block", F.lit(0).alias("side")).unionByName(two.select("gid", F.col("block2").alias("block"), F.lit(1).alias("side")))
    deal = deal.unionByName(blocks_.where("pure IS NULL").select(F.col("block").alias("gid"), "block", F.lit(-1).alias("side")))
    met = placed.join(deal, "block").select("gid", "cls", "comp", "side", "n_shingles", "sig")
    kinds = "gid bigint, cls bigint, comp bigint, side int"
    return scratch.save(met.repartition("gid").sortWithinPartitions("gid", "cls").mapInArrow(_open, kinds), "open")


def _full_sets(classes: DataFrame, docs: DataFrame, reps: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(cls, members) of the classes concerned, made anew from their texts."""
    wanted = scratch.save(classes.join(reps.select("cls", F.col("rep").alias("_id")), "cls"), "wanted")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                made = list(_sets(part.column(1)))
                right = [i for i, (s, c) in enumerate(zip(made, part.column(0).to_pylist(), strict=True)) if len(s) and class_of(s) == c]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(right, pa.int64())), pa.array([made[i].tobytes() for i in right], pa.binary())], ["cls", "members"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(bounded(wanted), "_id").select("cls", "_text")
    sets = scratch.save(texts.mapInArrow(make, "cls bigint, members binary"), "sets")
    scratch.drop(wanted)
    # rows of one id may share a class
    return sets.groupBy("cls").agg(F.first("members").alias("members"))


class _Join:
    """One run of the join: its classes, and how links between them are confirmed."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch):
        self.docs, self.id_col, self.text_col, self.scratch = docs, id_col, text_col, scratch
        rows = scratch.save(sketch(docs, id_col, text_col), "sketches")
        usable = rows.where("cls IS NOT NULL AND _id IS NOT NULL")
        self.classes = scratch.save(usable.groupBy("cls").agg(F.min("_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "sig", "keys"))), "classes")
        self.rows = scratch.save(rows.select("_id", "n_shingles", "cls"), "rows")
        scratch.drop(rows)

    def full_sets(self, classes: DataFrame) -> DataFrame:
        return _full_sets(classes, self.docs, self.classes, self.scratch, self.id_col, self.text_col)

    def live(self, nodes: DataFrame) -> DataFrame:
        """The rows, with m, of nodes of two classes or more; of equal nodes up to a leaf's size one."""
        marks = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(8))).alias("y")]
        # larger nodes go on, so each is a chance of its own
        alone = F.when(F.col("m") > LEAF, F.col("node")).alias("alone")
        several = nodes.groupBy("node").agg(*marks).where("m > 1").groupBy("m", "x", "y", alone).agg(F.min("node").alias("node"))
        return self.scratch.save(nodes.join(several.select("node", "m"), "node"), "live")

    def hubbed(self, nodes: DataFrame) -> DataFrame:
        """(gid, cls) of large nodes (node, cls, m), dealt into leaves that share hubs."""
        return _dealt(nodes, "node", F.ceil(F.col("m") / max(LEAF * 3 // 4, 1)).cast("int"), (LEAF // 4) / F.col("m"))

    def confirmed(self, leaves: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Confirmed links of what leaves (gid, cls) hold, and the classes of families too large for one block, if any."""
        scratch = self.scratch
        families = connected_components(_compared(leaves, self.classes), scratch).withColumnRenamed("comp", "family").withColumnRenamed("node", "cls")
        sized = scratch.save(families.join(self.classes.select("cls", "n_shingles"), "cls"), "families")
        totals = sized.groupBy("family").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("t"))
        huge = scratch.save(totals.where((F.col("c") > FAMILY) | (F.col("t") > SHINGLES)), "large-families")
        in_blocks = sized.join(huge.select("family"), "family", "left_anti").select(F.col("family").alias("gid"), "cls")
        of_huge = None
        if not huge.isEmpty():
            chunks = F.greatest(F.ceil(F.col("c") / max(FAMILY // 2, 1)), F.ceil(F.col("t") / (SHINGLES // 2))).cast("int")
            in_blocks = in_blocks.unionByName(_dealt(sized.join(huge, "family"), "family", chunks, HUBS / F.col("c")))
            of_huge = sized.join(huge.select("family"), "family", "left_semi").select("cls")
        sets = self.full_sets(sized.select("cls"))
        blocks_ = in_blocks.join(sets, "cls").select("gid", "cls", "members").repartition("gid").sortWithinPartitions("gid", "cls")
        return scratch.save(blocks_.mapInArrow(_confirm_blocks, LINKS), "confirmed"), of_huge

    def leaves_and_dense(self) -> tuple[DataFrame, DataFrame | None]:
        """(node, cls) of all leaves, and (node, cls, m) of dense nodes."""
        scratch = self.scratch
        now = self.live(self.classes.select(F.explode("keys").alias("node"), "cls", F.lit(None).cast("bigint").alias("of")))
        leaves, dense = [], []
        for depth in range(1, DEPTH + 1):
            leaves.append(now.where(F.col("m") <= LEAF).select("node", "cls"))
            large = now.where(F.col("m") > LEAF)
            if large.isEmpty():
                break
            stays = F.lit(True) if depth == DEPTH else F.coalesce(F.col("m") > SHRINK * F.col("of"), F.lit(False))
            dense.append(large.where(stays).select("node", "cls", "m"))
            more = large.where(~stays).join(self.classes.select("cls", "sig"), "cls").select("node", "cls", "sig", "m").mapInArrow(_children, "node bigint, cls bigint, of bigint")
            more = scratch.save(more, "nodes")
            if more.isEmpty():
                break
            now = self.live(more)
            scratch.drop(more)
        every = None if not dense else functools.reduce(DataFrame.unionByName, dense)
        return functools.reduce(DataFrame.unionByName, leaves), None if every is None or every.isEmpty() else every

    def components(self) -> DataFrame:
        """(node, comp) of classes that link with others."""
        scratch = self.scratch
        leaves, dense = self.leaves_and_dense()
        met = leaves.withColumnRenamed("node", "gid")
        if dense is not None:
            met = met.unionByName(self.hubbed(dense))
        sound, of_huge = self.confirmed(met)
        comps = connected_components(sound, scratch)
        # what hubs left apart: in the leaves of large families and in dense nodes
        rest = [] if dense is None else [dense.select("node", "cls")]
        if of_huge is not None:
            rest.append(leaves.join(of_huge, "cls", "left_semi").select("node", "cls"))
        if rest:
            nodes = rest[0]
            for more in rest[1:]:
                nodes = nodes.unionByName(more)
            apart = _unjoined(nodes, comps, self.classes, scratch)
            if apart is not None and not apart.isEmpty():
                sets = self.full_sets(apart.select("cls").distinct())
                blocks_ = apart.join(sets, "cls").select("gid", "cls", "members", "comp", "side").repartition("gid").sortWithinPartitions("gid", "cls")
                comps = connected_components(sound.unionByName(scratch.save(blocks_.mapInArrow(_confirm_blocks, LINKS), "confirmed")), scratch)
        return comps

    def of_rows(self) -> DataFrame:
        """_id, n_shingles, cls, component_id of each row; null for rows without an id or a set."""
        scratch = self.scratch
        comps = self.components()
        rooted = self.classes.select("cls", "rep").join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
        rooted = scratch.save(rooted, "rooted")
        least = rooted.groupBy("comp").agg(F.min("rep").alias("component_id"))
        of_class = scratch.save(rooted.join(least, "comp").select("cls", "component_id"), "of-class")
        scratch.drop(self.classes, rooted)
        return self.rows.join(of_class, "cls", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept of each row."""
    rows = _Join(docs, id_col, text_col, Scratch(docs.sparkSession, "cpsjoin")).of_rows()
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return rows.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns: all of an empty set, and one of each component.

    That one has the smallest id, then the smallest hash of its text; a row without an
    id stays only where no other of its component has one.  So rows are told apart by id and text,
    and each is judged by its own text.
    """
    spark = docs.sparkSession
    key = free_name(docs, "_key")
    told = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h2"))
    keyed = docs.withColumn(key, told)
    scratch = Scratch(spark, "cpsjoin")
    rows = scratch.save(_Join(keyed.select(key, text_col), key, text_col, scratch).of_rows().where("component_id IS NOT NULL").select("_id", "component_id"), "judged")
    marks = rows.groupBy("_id").agg(F.count("*").alias("n"), F.first("component_id").alias("component_id"))
    marks = scratch.save(marks.select("_id", "n", (F.col("_id") == F.col("component_id")).alias("stays")).where("NOT stays OR n > 1"), "marks")

    def flat(c: Column) -> list[Column]:
        return [c["no_id"].cast("string"), F.coalesce(c["id"].cast("string"), F.lit("")), c["h1"], c["h2"]]

    names = [free_name(keyed, f"_k{i}") for i in range(4)]
    wide = keyed.withColumns(dict(zip(names, flat(F.col(key)), strict=True)))
    of = lambda df: bounded(df.select(*(c.alias(n) for c, n in zip(flat(F.col("_id")), names, strict=True))))
    unmarked = wide.join(of(marks), names, "left_anti")
    # rows that agree in id and text: one is enough
    copies = wide.join(of(marks.where("stays")), names, "left_semi").dropDuplicates(names)
    return unmarked.unionByName(copies).select(*docs.columns)
