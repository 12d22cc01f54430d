"""Merkle manifest of a dataset: a digest for every row, a root for every source and one over all.

A node of the tree is the SHA-256 of up to three digests, as hexadecimal text, one
after the other. The leaves of a source are appended in order to a list of open
subtrees. A leaf's witness, the siblings on its way up, is partial at first: when
the later siblings of an open subtree complete it, the witnesses below it are
extended by them. A task appends a block of 3^6 consecutive leaves, aligned with
the tree, and the roots of the blocks are treated as further appends, block by
block again, until one node is left; so are then the roots of the sources. A
block's own witness is the rest of the witness of all that stands below it.

Places in a source are counted from range partitions, so no source is ordered in
one task. Leaves ascend by document id (none first), then by digest; sources by
their UTF-8 bytes, none first. Null columns are `-` in a leaf and empty texts
`0:`. Repeated rows are leaves of their own, next to each other. Extra columns are
not read. An empty table gives an empty result and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import bounded, col, scratch

ARITY = 3
BLOCK_LEVELS = 6
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node(digests: list[bytes]) -> bytes:
    """Digest over the hexadecimal text of digests."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def depth(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Appender:
    """Streaming append: open subtrees by height, each with the partial witnesses of its leaves."""

    def __init__(self) -> None:
        self.open: list[list[tuple[bytes, list[bytearray]]]] = [[]]
        self.witnesses: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        self.witnesses.append(bytearray())
        self.open[0].append((digest, [self.witnesses[-1]]))
        level = 0
        while len(self.open[level]) == ARITY:
            self._complete(level)
            level += 1

    def _complete(self, level: int) -> None:
        """Turn the open run of a level into its parent, and extend the witnesses below it by the siblings."""
        run, self.open[level] = self.open[level], []
        for i, (_, below) in enumerate(run):
            siblings = b"".join(digest for j, (digest, _) in enumerate(run) if j != i)
            for witness in below:
                witness += siblings
        if len(self.open) == level + 1:
            self.open.append([])
        self.open[level + 1].append((node([digest for digest, _ in run]), [w for _, below in run for w in below]))

    def close(self, levels: int) -> bytes:
        """Complete the runs that nothing more is appended to, up to the node `levels` above the leaves."""
        for level in range(levels):
            if self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def fold(digest: bytes, witness: bytes, place: int, n: int) -> tuple[bytes, int]:
    """Root over a leaf and its witness, and how many bytes of the witness it took."""
    at = 0
    while n > 1:
        first = place - place % ARITY
        others = min(ARITY, n - first) - 1
        siblings = [witness[at + i * DIGEST : at + (i + 1) * DIGEST] for i in range(others)]
        at += others * DIGEST
        siblings.insert(place % ARITY, digest)
        digest, place, n = node(siblings), place // ARITY, -(-n // ARITY)
    return digest, at


# --- leaves and their places


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row, with this text."""
    values = [text if name == "text" else col(name) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*map(_field, values)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the source, in order), digest, and the digest after tampering where it differs."""
    text = col("text")
    tampered = (F.crc32(col("doc_id").cast("string")) % 2 == 0) & text.contains("\n")
    return docs.select(
        col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), col("source")), F.lit("")).alias("key"),
        leaf(text).alias("digest"),
        F.when(tampered, leaf(F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"),
    )


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Add `position` within the key, in this order, and `n`, the rows of the key; also returns the largest `n`.

    Rows are sorted in range partitions; a row's place is its place in the
    partition's share of the key, after the shares of the partitions before.
    """
    parted = (
        rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
        .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    )
    fixed = scratch(parted, "merkle-order")
    shares = fixed.groupBy("key", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("share"))
    in_key = Window.partitionBy("key")
    before = in_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shares.select(
        "key", "part",
        (F.coalesce(F.sum("share").over(before), F.lit(0)) - F.col("first")).alias("offset"),
        F.sum("share").over(in_key).alias("n"),
    )
    placed = fixed.join(offsets, ["key", "part"])
    most = offsets.agg(F.max("n")).first()[0] or 0
    return placed.select(*rows.columns, (F.col("row") + F.col("offset")).alias("position"), "n"), most


# --- blocks


def _append(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Appender | None = None
        held: list[pa.RecordBatch] = []
        current, n = None, 0

        def closed() -> pa.RecordBatch:
            root = state.close(min(levels, depth(n)))
            rows = pa.Table.from_batches(held).combine_chunks()
            more = {
                "witness": pa.array(list(map(bytes, state.witnesses)), pa.binary()),
                "root": pa.array([root, *[None] * (rows.num_rows - 1)], pa.binary()),
            }
            for name, values in more.items():
                rows = rows.append_column(name, values)
            return rows.to_batches()[0]

        for batch in batches:
            names, blocks = batch.column("key").to_pylist(), batch.column("block").to_pylist()
            digests, sizes = batch.column("digest").to_pylist(), batch.column("n").to_pylist()
            begin = 0
            for block, same in groupby(zip(names, blocks)):
                if block != current:
                    if state:
                        yield closed()
                    state, held, current, n = Appender(), [], block, sizes[begin]
                count = sum(1 for _ in same)
                for digest in digests[begin : begin + count]:
                    state.append(digest)
                held.append(batch.slice(begin, count))
                begin += count
        if state:
            yield closed()

    return run


def append_blocks(items: DataFrame, levels: int) -> DataFrame:
    """Append the items (key, position, n, digest, ...) block by block: adds block, witness and, at the first, the root."""
    ordered = (
        items.withColumn("block", F.floor(F.col("position") / ARITY**levels))
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", "position")
    )
    schema = ", ".join(f"`{name}` {kind}" for name, kind in ordered.dtypes) + ", witness binary, root binary"
    return scratch(bounded(ordered).mapInArrow(_append(levels), schema), "merkle-blocks")


def trees(items: DataFrame, most: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the items, and per block (key, block) the further witness and the key's root.

    `most` is the largest `n`. Roots of blocks are appended in turn until every
    key has one; each round has 3^levels times fewer rows than the one before.
    """
    rounds, size, block = [], most, ARITY**levels
    while True:
        rounds.append(append_blocks(items, levels))
        size = -(-size // block)
        roots = rounds[-1].where("root IS NOT NULL").select(
            "key", F.col("block").alias("position"), F.ceil(F.col("n") / block).alias("n"), F.col("root").alias("digest")
        )
        if size <= 1:
            break
        items = roots
    # one root a key now; its witness goes down again, block by block
    further = roots.select("key", F.col("position").alias("block"), F.lit(b"").alias("further"), F.col("digest").alias("top"))
    for above in reversed(rounds[1:]):
        rest = F.concat("witness", "further").alias("further")
        further = above.join(further, ["key", "block"]).select("key", F.col("position").alias("block"), rest, "top")
    return rounds[0], further


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            witness, top = r["witness"] + r["further"], r["root"]
            proof = hashlib.sha256(witness.hex().encode()).hexdigest()
            middle, used = fold(r["tampered"] or r["digest"], witness, r["position"], r["n"])
            folded, _ = fold(middle, witness[used:], r["source_position"], r["sources"])
            rows.append((r["doc_id"], r["digest"].hex(), r["subroot"].hex(), top.hex(), proof, folded.hex(), folded == top))
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        columns = zip(*rows) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)


_NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
_SCHEMA = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def witnesses(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row: doc_id, digest, tampered, position, n, witness, further (of the block), subroot, source_position, sources, root."""
    placed, most = numbered(scratch(leaves(docs), "merkle-leaves"), "doc_id", "digest")
    blocks, further = trees(placed, most, levels)
    subroots = further.select("key", F.col("top").alias("digest")).distinct()
    over, most = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), "name")
    sources, rest = trees(over, most, levels)
    ends = sources.join(rest, ["key", "block"]).select(
        F.col("name").alias("key"),
        F.concat("witness", "further").alias("source_witness"),
        F.col("position").alias("source_position"),
        F.col("n").alias("sources"),
        F.col("top").alias("whole"),
    )
    above = further.join(ends, "key").select(
        "key",
        "block",
        F.concat("further", "source_witness").alias("further"),
        F.col("top").alias("subroot"),
        "source_position",
        "sources",
        "whole",
    )
    return blocks.drop("root").join(above, ["key", "block"]).withColumnRenamed("whole", "root").drop("key", "block")


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, digest of the witness, root folded from the tampered leaf, and whether it is the root."""
    return bounded(witnesses(docs, levels)).mapInArrow(_verify, _SCHEMA)
