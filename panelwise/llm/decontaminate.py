"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact check.

A benchmark item of n words is compared with the windows of n words of every
document (with the whole document if it is shorter). A window's 64-bit SimHash
sums its five-word shingles, each weighted by the bytes of its words. Items of a
size are indexed by 8 blocks of 8 bits; of two fingerprints within radius 23 at
least one block differs by two bits at most, so probing each block's value and the
36 values within two bits of it finds all items within the radius. Pairs found are
decided exactly: weighted Jaccard similarity of the two bags of shingles, 0.8 or
more. A pair of lower similarity can stand outside the radius: of 12,815 made-up
pairs of similarity 0.80 to 0.85 none differed by more than 22 bits, so the miss
rate there is not shown to be 0, but small.

Windows are formed where they can matter: a window without any shingle of an item
of its size has similarity 0 with all of them, so only windows that cover such a
shingle get a fingerprint. Nothing is lost by it, and whole texts are searched.

Null texts count as empty. Items without words match nothing; items of fewer than
five words have one shingle of all their words. Repeated rows of a document count
once in the result, items with equal texts are found each. A null id is an id of
its own. Extra columns are not read, or carried along untouched by
`without_passages`. Empty tables give an empty result, or all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import bounded, col, scratch, slices, strings
from panelwise.llm.words import SHINGLE_WORDS, windows, word_hashes

SIMILARITY = 0.8
RADIUS = 23
INDEX_BLOCKS = 8
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 1 << 25
RUN_STARTS = 1 << 14
_FILTER_BITS = 22


def fingerprints(counters: np.ndarray) -> np.ndarray:
    """SimHash of rows of 64 counters."""
    return np.packbits(counters > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def signed(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What each shingle adds to the 64 counters: its weight, with the sign of the hash's bit."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.int64) * 2 - 1) * weights[:, None]


def runs(starts: np.ndarray, span: int) -> list[np.ndarray]:
    """Starts of windows in runs whose windows touch, of at most `RUN_STARTS` each: what is summed up at once."""
    cuts = np.flatnonzero(np.diff(starts) > span) + 1
    parts = np.split(starts, cuts) if len(starts) else []
    return [part[i : i + RUN_STARTS] for part in parts for i in range(0, len(part), RUN_STARTS)]


class HammingIndex:
    """Finds all indexed fingerprints within a radius of each query."""

    def __init__(self, prints: np.ndarray, radius: int = 15):
        self.prints, self.radius = prints, radius
        # of two fingerprints within the radius, some block differs by no more bits than these
        self.flips = [m for m in range(256) if m.bit_count() <= radius // INDEX_BLOCKS]
        self.order, self.keys = [], []
        for b in range(INDEX_BLOCKS):
            block = self._block(prints, b)
            order = np.argsort(block, kind="stable")
            self.order.append(order)
            self.keys.append(block[order])

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(8 * b)).astype(np.uint8)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, indexed) within the radius, each once."""
        found = []
        for b in range(INDEX_BLOCKS):
            block = self._block(queries, b)
            for flip in self.flips:
                value = block ^ np.uint8(flip)
                left, right = np.searchsorted(self.keys[b], value, "left"), np.searchsorted(self.keys[b], value, "right")
                count = right - left
                query = np.repeat(np.arange(len(queries)), count)
                at = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
                item = self.order[b][at]
                near = np.bitwise_count(queries[query] ^ self.prints[item]) <= self.radius
                found.append(query[near] * len(self.prints) + item[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


@dataclass
class _Items:
    """Items of one size in words."""

    words: int
    ids: list = field(default_factory=list)
    bags: list = field(default_factory=list)  # sorted hashes, counts, weights, total weight
    index: HammingIndex | None = None


class Benchmark:
    """Index over a bounded block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None], radius: int = RADIUS):
        self.sizes: dict[int, _Items] = {}
        prints: dict[int, list[int]] = {}
        anchors: dict[int, list[tuple[int, int]]] = {}  # shingle words -> (hash, size)
        hashes, lengths, first = word_hashes(strings(pa.array(texts, pa.string())))
        for i, item in enumerate(ids):
            w, n = slice(first[i], first[i + 1]), int(first[i + 1] - first[i])
            if not n:
                continue
            k = min(SHINGLE_WORDS, n)
            of = windows(hashes[w], k)[: n - k + 1]
            weight = np.convolve(lengths[w], np.ones(k, np.int64), "valid")
            unique, at, count = np.unique(of, return_index=True, return_counts=True)
            items = self.sizes.setdefault(n, _Items(n))
            items.ids.append(item)
            items.bags.append((unique, count, weight[at], int(weight.sum())))
            prints.setdefault(n, []).append(fingerprints(signed(of, weight).sum(axis=0, keepdims=True))[0])
            anchors.setdefault(k, []).extend((int(h), n) for h in unique)
        for n, items in self.sizes.items():
            items.index = HammingIndex(np.array(prints[n], np.uint64), radius)
        self.anchors = {}
        for k, pairs in anchors.items():
            of = np.unique(np.array([h for h, _ in pairs], np.uint64))
            sizes: list[set[int]] = [set() for _ in of]
            for h, n in pairs:
                sizes[np.searchsorted(of, np.uint64(h))].add(n)
            small = np.zeros(1 << _FILTER_BITS, bool)
            small[of >> np.uint64(64 - _FILTER_BITS)] = True
            self.anchors[k] = of, sizes, small

    def matches(self, texts: pa.Array) -> list[list[tuple]]:
        """Per text: (item, first word of the window, similarity), the best window of each item."""
        hashes, lengths, first = word_hashes(texts)
        found: list[list[tuple]] = [[] for _ in range(len(texts))]
        for k, (anchor, sizes, small) in self.anchors.items():
            if len(hashes) < k:
                continue
            every = windows(hashes, k)
            maybe = np.flatnonzero(small[every >> np.uint64(64 - _FILTER_BITS)])
            at = np.searchsorted(anchor, every[maybe])
            at[at == len(anchor)] = 0
            hit = anchor[at] == every[maybe]
            places, which = maybe[hit], at[hit]
            text = np.searchsorted(first, places, "right") - 1
            inside = places + k <= first[text + 1]
            places, which, text = places[inside], which[inside], text[inside]
            for t in np.unique(text).tolist():
                mine = text == t
                w = slice(first[t], first[t + 1])
                found[t] += self._search(every[w], lengths[w], k, places[mine] - first[t], [sizes[x] for x in which[mine]])
        return found

    def _search(self, every: np.ndarray, lengths: np.ndarray, k: int, places: np.ndarray, sizes: list[set[int]]) -> list[tuple]:
        n = len(lengths)
        every = every[: n - k + 1]
        weight = np.convolve(lengths, np.ones(k, np.int64), "valid")
        best: dict[int, tuple] = {}
        for size in sorted(set().union(*sizes)):
            items, span = self.sizes[size], min(size, n)
            here = places[[size in s for s in sizes]]
            cover = np.zeros(n - k + 2, np.int64)  # starts of windows that cover one of these shingles
            np.add.at(cover, np.maximum(here - span + k, 0), 1)
            np.add.at(cover, here + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover)[: n - span + 1])
            for run in runs(starts, span):
                low, high = run[0], run[-1] + span - k + 1
                sums = np.zeros((high - low + 1, 64), np.int64)
                np.cumsum(signed(every[low:high], weight[low:high]), axis=0, out=sums[1:])
                prints = fingerprints(sums[run - low + span - k + 1] - sums[run - low])
                for q, i in zip(*items.index.search(prints)):
                    s = int(run[q])
                    similarity = self._similarity(items.bags[i], every[s : s + span - k + 1], weight[s : s + span - k + 1])
                    if similarity >= SIMILARITY and similarity > best.get((size, i), (0, 0, 0.0))[2]:
                        best[size, i] = (items.ids[i], s, similarity)
        return list(best.values())

    @staticmethod
    def _similarity(bag: tuple, window: np.ndarray, weight: np.ndarray) -> float:
        """Weighted Jaccard similarity of two bags of shingles."""
        unique, count, item_weight, total = bag
        mine, mine_count = np.unique(window, return_counts=True)
        at = np.searchsorted(unique, mine)
        at[at == len(unique)] = 0
        same = unique[at] == mine
        shared = int((np.minimum(count[at[same]], mine_count[same]) * item_weight[at[same]]).sum())
        return shared / (total + int(weight.sum()) - shared)


def benchmark_blocks(benchmark: DataFrame) -> Iterator[Benchmark]:
    """Indexes over all items, in blocks of a bounded number of items and bytes.

    The benchmark is a stated query set. One block at a time goes to the driver
    and on to the tasks, and the documents are read once a block.
    """
    items = benchmark.select(col("item_id").cast("bigint").alias("item_id"), col("text").alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(-(-size.n // BLOCK_ITEMS), -(-(size.bytes or 0) // BLOCK_BYTES), 1)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect() if blocks > 1 else items.collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text or ""))
        yield Benchmark([r.item_id for r in rows], [r.text for r in rows])


def _find(index: Benchmark):
    types = pa.int64(), pa.int64(), pa.int64(), pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = index.matches(strings(part.column("text")))
                rows = [(d, *m) for d, ms in zip(part.column("doc_id").to_pylist(), found) for m in ms]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "item_id", "word", "similarity"])

    return run


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated documents: doc_id, item_id, first_word and similarity of the best window."""
    texts = bounded(docs).select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text"))
    schema = "doc_id bigint, item_id bigint, word bigint, similarity double"
    # written block by block, so that no plan holds more than one block of the benchmark
    parts = [scratch(texts.mapInArrow(_find(index), schema), "passages") for index in benchmark_blocks(benchmark)]
    found = reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct("similarity", (-F.col("word")).alias("word"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.word")).alias("first_word"), F.round("best.similarity", 6).alias("similarity")
    )


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, as they are."""
    at = bounded(docs).columns.index("text")
    last = None

    def clean(index: Benchmark):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, batch.schema.names[at]):
                    keep = [not m for m in index.matches(strings(part.column(at)))]
                    yield part if all(keep) else part.filter(pa.array(keep))

        return run

    for index in benchmark_blocks(benchmark):
        # no plan holds more than one block of the benchmark
        last = docs if last is None else scratch(last, "decontaminated")
        last = last.mapInArrow(clean(index), docs.schema)
    return last
