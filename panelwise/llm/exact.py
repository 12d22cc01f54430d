"""Exact duplicates through recipes of content-defined chunks.

A text without its ASCII white space is cut where a rolling hash of the last 32
bytes says so, so equal texts give equal chunks wherever they stand. Every chunk
is moved once, to be compared byte by byte with the chunks of the same 128-bit
identifier. Only then do the identifiers stand for the chunks, and a document is
its ordered list of identifiers: groups are found by comparing these lists, and
long texts are not moved again.

Null texts count as empty, and empty texts are equal to each other. Of equal
texts the row with the most code points stays, then the smallest document id
(rows without an id come last), then one of the repeated rows. Extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import SALTS, bounded, col, lookup, scratch, slices, strings
from panelwise.llm.words import blanks, string_bytes

WINDOW = 32
SMALLEST, LARGEST = 64, 1 << 16
MEAN_BITS = 10
REMEMBERED_BYTES = 1 << 24
_GEAR = np.random.default_rng(9).integers(0, 1 << 32, 256, dtype=np.uint32)
ROWS = "kind int, row_id bigint, doc_id bigint, n_chars bigint, text_sha256 string, recipe binary, chunk binary, content binary"
_SCHEMA = pa.schema(
    [
        ("kind", pa.int32()),
        ("row_id", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("text_sha256", pa.string()),
        ("recipe", pa.binary()),
        ("chunk", pa.binary()),
        ("content", pa.binary()),
    ]
)


def squeezed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts without ASCII white space, and where each text begins."""
    raw, begins = string_bytes(texts)
    solid = ~blanks(raw)
    before = np.concatenate([[0], np.cumsum(solid)])
    return raw[solid], before[begins]


def cuts(raw: np.ndarray, mean_bits: int = MEAN_BITS) -> np.ndarray:
    """Places after which the rolling hash of the last 32 bytes asks for a cut."""
    h = _GEAR[raw]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return np.flatnonzero((h >> np.uint32(32 - mean_bits)) == 0) + 1


def pieces(size: int, places: np.ndarray) -> list[tuple[int, int]]:
    """Chunks of one text of `size` bytes, given the places the hash asks for.

    Places nearer than 64 bytes to the last cut are passed over, so the hash never
    looks at another text; a chunk without a place for 64 KiB is cut there.
    """
    out, begin = [], 0
    for place in [*places.tolist(), size]:
        if place - begin < SMALLEST and place != size:
            continue
        while place - begin > LARGEST:
            out.append((begin, begin + LARGEST))
            begin += LARGEST
        if place > begin:
            out.append((begin, place))
            begin = place
    return out


def identifier(chunk: bytes, attempt: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed=attempt)


def _chunked(attempt: int, name):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_id = TaskContext.get().partitionId() << 40
        seen: set[bytes] = set()
        held = 0
        for batch in batches:
            for part in slices(batch):
                texts = strings(part.column("text"))
                raw, begins = squeezed(texts)
                data, places = raw.tobytes(), cuts(raw)
                ends = np.searchsorted(places, begins)
                rows = []
                for i, (doc, n) in enumerate(zip(part.column("doc_id").to_pylist(), pc.utf8_length(texts).to_pylist())):
                    begin, end = int(begins[i]), int(begins[i + 1])
                    text = data[begin:end]
                    recipe = []
                    for a, b in pieces(end - begin, places[ends[i] : ends[i + 1]] - begin):
                        chunk = text[a:b]
                        recipe.append(name(chunk, attempt))
                        if chunk not in seen:
                            if held > REMEMBERED_BYTES:
                                seen.clear()
                                held = 0
                            seen.add(chunk)
                            held += len(chunk)
                            rows.append((1, None, None, None, None, None, recipe[-1], chunk))
                    rows.append((0, row_id, doc, n, hashlib.sha256(text).hexdigest(), b"".join(recipe), None, None))
                    row_id += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    return run


def recipes(docs: DataFrame, name=identifier) -> DataFrame:
    """One row a document: row_id, doc_id, n_chars, text_sha256, recipe (verified identifiers, joined).

    If two different chunks ever share an identifier, all are named anew with
    another seed, so identifiers in the result stand for one chunk each.
    """
    texts = bounded(docs).select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text"))
    attempt = 0
    while True:
        rows = scratch(texts.mapInArrow(_chunked(attempt, name), ROWS), "recipes", "kind")
        chunks = rows.where("kind = 1").select("chunk", "content").distinct()
        if chunks.groupBy("chunk").count().where("count > 1").isEmpty():
            return rows.where("kind = 0").select("row_id", "doc_id", "n_chars", "text_sha256", "recipe")
        attempt += 1


def exact_groups(docs: DataFrame, name=identifier) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = recipes(docs, name).withColumn("salt", F.pmod("row_id", F.lit(SALTS)))
    # the greatest of these is the row that stays; a missing id counts as the last
    order = F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"), (-F.col("row_id")).alias("minus_row"))
    parts = rows.groupBy("recipe", "salt").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("recipe").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    return lookup(rows, "recipe", "salt", groups).select(
        "doc_id",
        (-F.col("best.minus_id")).alias("keep_id"),
        "group_size",
        (F.col("row_id") == -F.col("best.minus_row")).alias("kept"),
        "text_sha256",
    )
