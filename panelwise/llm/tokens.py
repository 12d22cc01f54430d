"""Token ids of documents in fixed-width bit packing, with random access.

A store is a table of blocks in ascending document order. A block holds whole
documents: their ids and where each ends, and the token ids packed into as many
bits as the vocabulary needs. 64 ids take exactly `width` words of 64 bits, so id
i lies in the group of words at (i // 64) * width, and any run of ids is unpacked
with numpy without touching what comes before.

Null texts count as empty; an empty text is the end id alone. Rows with a null
document id come first; repeated rows are all stored, one after the other. Extra
columns are not read. An empty table gives an empty store.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import bounded, col, scratch, slices, strings

GROUP = 64
BLOCK_IDS = 1 << 16
CACHED_PIECES = 350_000
LONGEST_CACHED = 64
AT_ONCE = 512
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which may begin a contraction
BLOCKS = (
    "shard int, block int, first_id bigint, n_ids bigint, width int, "
    "doc_ids array<bigint>, doc_ends array<bigint>, packed binary"
)
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def bit_width(vocabulary: int) -> int:
    """Fewest bits that tell all ids of a vocabulary apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in `width` bits each, low bits first, in whole groups of 64."""
    groups = -(-len(ids) // GROUP)
    padded = np.zeros(groups * GROUP, np.uint64)
    padded[: len(ids)] = ids
    if width in _WHOLE:
        return padded.astype(_WHOLE[width]).tobytes()
    table = padded.reshape(groups, GROUP)
    words = np.zeros((groups, width), "<u8")
    for i in range(GROUP):
        word, shift = divmod(i * width, 64)
        words[:, word] |= table[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= table[:, i] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(packed: bytes, width: int, start: int, count: int) -> np.ndarray:
    """The `count` ids from place `start` on; reads only the groups that hold them."""
    first, last = start // GROUP, -(-(start + count) // GROUP)
    size = width * 8
    if width in _WHOLE:
        ids = np.frombuffer(packed, _WHOLE[width], (last - first) * GROUP, first * size).astype(np.uint32)
    else:
        words = np.frombuffer(packed, "<u8", (last - first) * width, first * size).reshape(-1, width)
        mask = np.uint64((1 << width) - 1)
        ids = np.empty((last - first, GROUP), np.uint32)
        for i in range(GROUP):
            word, shift = divmod(i * width, 64)
            value = words[:, word] >> np.uint64(shift)
            if shift + width > 64:
                value = value | words[:, word + 1] << np.uint64(64 - shift)
            ids[:, i] = value & mask
        ids = ids.reshape(-1)
    return ids[start - first * GROUP : start - first * GROUP + count]


class Encoder:
    """Whole texts to ids with the tokenizers library, each different piece encoded once.

    The byte-level pre-tokenizer never joins characters across a blank that stands
    alone between two others: a match either begins at the blank or ends before
    it. Nor does it join letters and the punctuation after them. Cutting there and
    joining the pieces' ids gives the ids of the whole text, and pieces repeat, so
    most ids come from a bounded cache of two generations. Texts with other runs
    of white space are cut with a pattern; texts with an added token's string, and
    all texts for a tokenizer of another kind, are encoded in one go.
    """

    cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shape = json.loads(definition)
        before = shape.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.pieces = plain and not shape.get("normalizer")
        vocabulary = self.tokenizer.get_vocab()
        # tokens that begin with a blank, which the byte-level alphabet writes as this letter
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        # ids of a piece after a blank; none of these begins or ends with white space
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.endings: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in done]

    def _ids_after_blank(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece after a blank; pieces without a blank are encoded many to a text and told apart by it."""
        lone = [p for p in pieces if " " in p or p.strip() != p or not p]
        found = dict(zip(lone, self._ids([" " + p for p in lone])))
        rest = [p for p in pieces if p not in found] if lone else pieces
        parts = [rest[i : i + AT_ONCE] for i in range(0, len(rest), AT_ONCE)]
        texts = [" " + " ".join(part) for part in parts]
        for part, done in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.asarray(done.ids, "<u4")
            ends = [*(np.flatnonzero(self.begins[ids]) * 4).tolist(), len(ids) * 4]
            if len(ends) == len(part) + 1:
                raw = ids.tobytes()
                found.update(zip(part, [raw[a:b] for a, b in zip(ends, ends[1:])]))
            else:
                found.update(zip(part, self._ids([" " + p for p in part])))
        return [found[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        whole = [not self.pieces or any(a in t for a in self.added) for t in texts]
        if any(whole):
            apart = iter(self._ids([t for t, w in zip(texts, whole) if w]))
            rest = iter(self.encode([t for t, w in zip(texts, whole) if not w]) if not all(whole) else [])
            return [next(apart if w else rest) for w in whole]
        cuts = [t.split(" ") for t in texts]
        new = set().union(*cuts).difference(self.known)
        odd = {p for p in new if p.strip() != p or not p}
        if odd:
            cuts = [c if odd.isdisjoint(c) else self.cut.split(t) for c, t in zip(cuts, texts)]
            new = set().union(*cuts).difference(self.known)
        self._learn(new)
        heads = list({c[0] for c in cuts})
        head = dict(zip(heads, self._ids(heads)))
        known = self.known.__getitem__
        ids = [b"".join([head[c[0]], *map(known, c[1:])]) for c in cuts]
        for p in [p for p in new if len(p) > LONGEST_CACHED or (odd and (p.strip() != p or not p))]:
            del self.known[p]
        if len(self.known) > CACHED_PIECES:
            self.known, self.older = {}, self.known
        return ids

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of these pieces into the younger generation."""
        known, older = self.known, self.older
        again = {p for p in pieces if p in older}
        known.update((p, older[p]) for p in again)
        unknown = pieces - again
        fresh = {p for p in unknown if p.isalpha()}
        ends = {}
        for p in unknown - fresh:
            core = p.rstrip(PUNCTUATION) if len(p) <= LONGEST_CACHED else ""
            if core.isalpha():
                ends[p] = core
            else:
                fresh.add(p)
        cores = {c for c in ends.values() if c not in known and c not in fresh}
        again = {c for c in cores if c in older}
        known.update((c, older[c]) for c in again)
        order = [*fresh, *(cores - again)]
        known.update(zip(order, self._ids_after_blank(order)))
        if len(self.endings) > CACHED_PIECES:
            self.endings = {}
        marks = list({p[len(c) :] for p, c in ends.items()}.difference(self.endings))
        self.endings.update(zip(marks, self._ids(marks)))
        endings = self.endings
        known.update((p, known[c] + endings[p[len(c) :]]) for p, c in ends.items())


_encoders: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder a worker and tokenizer."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def _blocks(definition: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = encoder(definition), TaskContext.get().partitionId()
        end, block, first = np.array([end_id], "<u4").tobytes(), 0, 0
        docs: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            ends = np.cumsum([len(x) // 4 for x in held])
            row = [shard, block, first, len(ids), width, docs, ends.tolist(), pack(ids, width)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES)], names=_NAMES)

        for batch in batches:
            for part in slices(batch):
                for doc, ids in zip(part.column("doc_id").to_pylist(), code.encode(strings(part.column("text")).to_pylist())):
                    if docs and size + len(ids) // 4 + 1 > BLOCK_IDS:
                        yield out()
                        block, first, size, docs, held = block + 1, first + size, 0, [], []
                    docs.append(doc)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
        if docs:
            yield out()

    return run


_NAMES = ["shard", "block", "first_id", "n_ids", "width", "doc_ids", "doc_ends", "packed"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encode all texts and write the store into the shared folder; returns its blocks as read back.

    The tokenizer file is read on the driver and its definition sent along, so
    executors need no copy of it. Documents are dealt out by ranges of their id, a
    shard each; ranges also split on the text, so one repeated id cannot fill a
    shard. A document's ids stay in one block, as its text stays in one row.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    width = bit_width(max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1))
    text = F.xxhash64(col("text"))
    ordered = (
        bounded(docs).select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text"), text.alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    return scratch(ordered.mapInArrow(_blocks(definition, end_id, width), BLOCKS), "tokens")


def shard_starts(blocks: DataFrame) -> DataFrame:
    """Place of each shard's first id in the whole store: one row a shard."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("bigint").alias("base"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            (row,), begin, rows = batch.slice(i, 1).to_pylist(), 0, []
            ids = unpack(row["packed"], row["width"], 0, row["n_ids"]).astype("<u4")
            for doc, end in zip(row["doc_ids"], row["doc_ends"]):
                rows.append((doc, row["shard"], row["first_id"] + begin, end - begin, zlib.crc32(ids[begin:end].tobytes())))
                begin = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"],
            )


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per stored document: doc_id, start (ids of all before it), n_tokens, ids_crc32, from the packed blocks."""
    read = bounded(blocks).mapInArrow(_documents, "doc_id bigint, shard int, at bigint, n_tokens bigint, ids_crc32 bigint")
    # one row a shard, and there are as many shards as tasks wrote the store
    placed = read.join(F.broadcast(shard_starts(blocks)), "shard")
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def block_index(blocks: DataFrame) -> DataFrame:
    """Written index of a store: shard, block, at (place of its first id in the whole store), n_ids. A row a block of 65,536 ids.

    Reads the blocks' numbers only, not their ids.
    """
    numbers = blocks.select("shard", "block", "first_id", "n_ids")
    # one row a shard, and there are as many shards as tasks wrote the store
    placed = numbers.join(F.broadcast(shard_starts(numbers)), "shard")
    placed = placed.select("shard", "block", (F.col("base") + F.col("first_id")).alias("at"), "n_ids")
    return scratch(placed.repartitionByRange("at").sortWithinPartitions("at"), "tokens-index")


def blocks_of_range(blocks: DataFrame, index: DataFrame, start: int, count: int) -> DataFrame:
    """The blocks that hold the ids, with `at`: looked up in the index, and named to the scan by shard and block.

    Blocks of a shard lie one after the other, so a range names one stretch of blocks a shard.
    """
    wanted = index.where((F.col("at") < start + count) & (F.col("at") + F.col("n_ids") > start)).select("shard", "block", "at")
    stretches = wanted.groupBy("shard").agg(F.min("block").alias("first"), F.max("block").alias("last")).collect()
    named = F.lit(False)
    for r in stretches:
        named = named | (F.col("shard") == r["shard"]) & F.col("block").between(r["first"], r["last"])
    return blocks.where(named).join(wanted, ["shard", "block"])


def read_range(blocks: DataFrame, start: int, count: int, index: DataFrame | None = None) -> np.ndarray:
    """`count` ids from place `start` of the whole store: reads only the blocks that hold them.

    `index` is the store's written `block_index`; without it one is made.
    """
    index = block_index(blocks) if index is None else index
    parts = []
    for r in blocks_of_range(blocks, index, start, count).orderBy("at").select("at", "n_ids", "width", "packed").toLocalIterator():
        a, b = max(start - r["at"], 0), min(start + count - r["at"], r.n_ids)
        parts.append(unpack(r.packed, r.width, a, b - a))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
