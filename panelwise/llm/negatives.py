"""Hard negatives: rows of other labels that score high against an anchor, but less than its positives.

An inverted multi-index finds them. Vectors are cut into two halves, each half has
a codebook, and a pair of codes is a cell. For an anchor, the score of any half of
a code is at most the score of the code's centre plus the anchor's length times the
code's radius, the largest distance of any row's half from its centre. A heap walks
the cells in descending sums of the two bounds (multi-sequence order) and stops once
the next sum is below what is still wanted, so the answer is that of a full scan.

The index is dealt into shards of neighbouring cells of about 2^20 components; a
cell larger than a shard is spread over several by a hash of the row. A search has
two steps: each anchor walks its home shard, which gives a floor for what it still
wants, then only the shards with a bound at or above the floor. It runs twice, for
the positives, whose scores fix the windows, and for the negatives in the windows.

Codebooks are k-means centres of about `SAMPLE` rows drawn by a hash; all rows are
indexed. Codes grow with the square root of the rows, up to 256 a half.

Rows with a null label, a null vector or a null or non-finite component take no
part. Shorter vectors are filled up with zeros. Scores tie by smaller id (rows
without one come last); repeated rows are rows of their own, and an anchor is only
left out of its own list. Components of a size at which a score could leave 64 bits
end the job. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import bounded, col, scratch

SAMPLE = 20_000
CELL_ROWS, MOST_CODES = 64, 256
SHARD_COMPONENTS = 1 << 20
RUN = 512
MOST = (1 << 63) - 1
LEAST = -MOST - 1
NO_ID = MOST
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


@dataclass(frozen=True)
class Codes:
    """Two codebooks with their radii, and the shape of the vectors."""

    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    dims: int
    store: str  # type of stored components
    exact: str  # type in which scores are exact

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = self.dims // 2
        return rows[..., :middle], rows[..., middle:]

    def bounds(self, vector: np.ndarray) -> list[np.ndarray]:
        """Per half, the most that any row of a code can score; a little more, for the rounding."""
        out = []
        for part, centres, radii in zip(self.halves(vector.astype(float)), self.centres, self.radii):
            score, more = centres @ part, math.sqrt(part @ part) * radii
            out.append(score + more + 1e-9 * (np.abs(score) + more) + 1e-6)
        return out

    def read(self, vectors: pa.Array) -> np.ndarray:
        """Stored vectors as a matrix."""
        raw = b"".join(vectors.to_pylist())
        return np.frombuffer(raw, self.store).reshape(-1, self.dims).astype(self.exact)


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs of places in two descending lists, by descending sum, each pair once."""
    heap = [(-(first[0] + second[0]), 0, 0)] if len(first) and len(second) else []
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, i, j
        if j + 1 < len(second):
            heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
        if not j and i + 1 < len(first):
            heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))


class Best:
    """The first k places of one list by descending score, then id; with a window for scores and a floor."""

    def __init__(self, k: int, low: int, high: int, floor: int):
        self.k, self.low, self.high, self.floor = k, low, high, floor
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)

    def wanted(self) -> float:
        """Scores below this one cannot change the list."""
        if self.low > self.high:
            return math.inf
        return max(self.low, self.floor, int(self.scores[-1]) if len(self.scores) == self.k else LEAST)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        keep = (scores >= self.wanted()) & (scores <= self.high)
        if keep.any():
            s, i, r = (np.concatenate(x) for x in ((self.scores, scores[keep]), (self.ids, ids[keep]), (self.rows, rows[keep])))
            order = np.lexsort((r, i, -s))[: self.k]
            self.scores, self.ids, self.rows = s[order], i[order], r[order]


class Shard:
    """Rows of neighbouring cells, in the order of their codes."""

    def __init__(self, codes: Codes, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.codes = codes
        self.uids = rows["uid"].to_numpy()
        self.ids = rows["order_id"].to_numpy()
        self.labels = rows["label"].to_numpy()
        self.vectors = codes.read(rows["vector"])
        cell = rows["code1"].to_numpy().astype(np.int64) * MOST_CODES + rows["code2"].to_numpy()
        edges = np.flatnonzero(np.diff(cell)) + 1
        begins, ends = [0, *edges.tolist()], [*edges.tolist(), len(cell)]
        self.cells = {divmod(int(cell[a]), MOST_CODES): (a, b) for a, b in zip(begins, ends)}
        self.present = [np.array(sorted({c[half] for c in self.cells})) for half in (0, 1)]

    def walk(self, vector: np.ndarray, allowed, lists: list[Best]) -> int:
        """Visit cells by descending bound until no list wants more; returns the number of rows scored."""
        order, bounds = [], []
        for present, bound in zip(self.present, self.codes.bounds(vector)):
            at = np.argsort(-bound[present], kind="stable")
            order.append(present[at].tolist())
            bounds.append(bound[present][at])
        scored, held, size = 0, [], 0

        def score() -> None:
            rows = np.concatenate([np.arange(a, b) for a, b in held]) if len(held) > 1 else np.arange(*held[0])
            rows = rows[allowed(rows)]
            scores = (self.vectors[rows] @ vector).astype(np.int64)
            for best in lists:
                best.add(scores, self.ids[rows], rows)

        wanted = min(best.wanted() for best in lists)
        for bound, i, j in multi_sequence(*bounds):
            if bound < wanted:
                break
            cell = self.cells.get((order[0][i], order[1][j]))
            if cell is None:
                continue
            held.append(cell)
            size += cell[1] - cell[0]
            if size >= RUN:
                score()
                scored, held, size = scored + size, [], 0
                wanted = min(best.wanted() for best in lists)
        if held:
            score()
        return scored + size


# --- the index


def integer_vectors(vectors: DataFrame, anchor: Column, scale: int) -> DataFrame:
    """Rows that take part: vec_id, order_id, label, anchor, floor(scale * x) of each component, and a row number."""
    x = col("embedding")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(col("label").isNotNull() & x.isNotNull() & usable).select(
        col("vec_id").cast("bigint").alias("vec_id"),
        F.coalesce(col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("order_id"),
        col("label").cast("bigint").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        # a product with a cast keeps the whole range of doubles, which floor() would cut to 64 bits
        F.transform(x, lambda v: v.cast("double") * scale).alias("x"),
    )
    return scratch(rows.withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")


def _matrix(values: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of whole numbers, filled up with zeros."""
    out = np.zeros((len(values), dims))
    ends = np.asarray(values.offsets, np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    place = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)
    out[np.repeat(np.arange(len(values)), lengths), place] = np.floor(flat)
    return out


def _assign(codes: Codes):
    def nearest(part: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = (centres**2).sum(1) - 2 * part @ centres.T
        code = far.argmin(1)
        return code, np.sqrt(((part - centres[code]) ** 2).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("x"), codes.dims)
            (code1, far1), (code2, far2) = (nearest(p, c) for p, c in zip(codes.halves(rows), codes.centres))
            packed = [r.tobytes() for r in rows.astype(codes.store)]
            columns = [batch.column(c) for c in ("uid", "vec_id", "order_id", "label", "anchor")]
            more = [pa.array(code1, pa.int32()), pa.array(code2, pa.int32()), pa.array(far1), pa.array(far2), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + more, names=_CELL_NAMES)

    return run


_CELL_NAMES = ["uid", "vec_id", "order_id", "label", "anchor", "code1", "code2", "far1", "far2", "vector"]
_CELLS = (
    "uid bigint, vec_id bigint, order_id bigint, label bigint, anchor boolean, "
    "code1 int, code2 int, far1 double, far2 double, vector binary"
)


def _shape(largest: float, dims: int) -> tuple[str, str]:
    """Types to store components in, and to add up scores in without rounding."""
    most = largest * largest * dims
    if most >= 2.0**63:
        raise ValueError(f"scores of components of {largest:g} do not fit 64 bits")
    store = next(t for t, top in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**63)) if largest < top)
    return store, "f8" if most < 2.0**53 else "i8"


def codebooks(rows: DataFrame, n: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of both halves, from the rows that a hash draws."""
    k = min(MOST_CODES, max(2, math.ceil(math.sqrt(n / CELL_ROWS))))
    share = max(1, math.ceil(min(1.0, SAMPLE / n) * (1 << 20)))
    filled = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("x")))
    drawn = rows.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < share).select(filled.alias("x"))
    middle = dims // 2
    out = []
    for begin, length in ((1, middle), (middle + 1, dims - middle)):
        half = drawn.select(F.slice("x", begin, length).alias("x"))
        different = half.distinct().limit(2).collect()
        if len(different) == 1:  # k-means asks for two different points
            out.append(np.array([different[0].x]))
            continue
        model = KMeans(k=k, maxIter=10, seed=seed, featuresCol="half").fit(half.select(array_to_vector("x").alias("half")))
        out.append(np.array(model.clusterCenters()))
    return out[0], out[1]


@dataclass
class Index:
    rows: DataFrame  # shard, code1, code2, uid, vec_id, order_id, label, anchor, vector
    codes: Codes
    cells: np.ndarray  # shard, code1, code2 of every cell, by shard


def build(rows: DataFrame, seed: int = 12, shard_components: int = SHARD_COMPONENTS) -> Index | None:
    """Code all rows, take the radii over all of them and deal them into shards of neighbouring cells."""
    sizes = rows.agg(
        F.count(F.lit(1)),
        F.max(F.size("x")),
        F.max(F.aggregate("x", F.lit(0.0), lambda most, v: F.greatest(most, F.abs(v)))),
    ).first()
    if not sizes[0]:
        return None
    n, dims, largest = sizes[0], max(2, sizes[1]), math.ceil(sizes[2]) + 1
    store, exact = _shape(largest, dims)
    none = np.zeros(0)
    codes = Codes(codebooks(rows, n, dims, seed), (none, none), dims, store, exact)
    cells = scratch(bounded(rows).mapInArrow(_assign(codes), _CELLS), "negatives-cells")
    radii = []
    for half in (1, 2):
        radius = np.zeros(len(codes.centres[half - 1]))
        # a row a code: at most 256
        for code, far in cells.groupBy(f"code{half}").agg(F.max(f"far{half}")).collect():
            radius[code] = far
        radii.append(radius)
    codes = Codes(codes.centres, (radii[0], radii[1]), dims, store, exact)
    # a row a cell: at most 65,536
    before = Window.orderBy("code1", "code2").rowsBetween(Window.unboundedPreceding, -1)
    counts = cells.groupBy("code1", "code2").agg(F.count(F.lit(1)).alias("size"))
    starts = counts.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    per_shard = max(1, shard_components // dims)
    place = F.col("start") + F.pmod(F.xxhash64("uid"), F.col("size"))
    placed = cells.join(F.broadcast(starts), ["code1", "code2"]).select(
        F.floor(place / per_shard).alias("shard"), "code1", "code2", "uid", "vec_id", "order_id", "label", "anchor", "vector"
    )
    index = scratch(placed, "negatives-index")
    # a row a cell and a row a shard
    known = np.array(sorted(map(tuple, index.select("shard", "code1", "code2").distinct().collect())), np.int64)
    return Index(index, codes, known)


# --- the search


def _route(index: Index):
    """Shards other than the home one that may hold what an anchor wants."""
    codes, cells = index.codes, index.cells
    begins = np.flatnonzero(np.concatenate([[True], np.diff(cells[:, 0]) > 0]))
    shards = cells[begins, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = codes.read(batch.column("vector"))
            homes = batch.column("shard").to_numpy()
            wanted = [min(w, default=MOST) for w in batch.column("floors").to_pylist()]
            for row in range(batch.num_rows):
                first, second = codes.bounds(vectors[row])
                best = np.maximum.reduceat(first[cells[:, 1]] + second[cells[:, 2]], begins)
                to = shards[(best >= wanted[row]) & (shards != homes[row])]
                if len(to):
                    same = batch.take(pa.array(np.full(len(to), row)))
                    yield same.set_column(batch.schema.get_field_index("shard"), "shard", pa.array(to, pa.int64()))

    return run


def _scan(codes: Codes, k: int, positives: bool):
    """Lists of each anchor in one shard. Rows of a shard come before the anchors sent to it."""

    def lists_of(windows: list[dict], floors: list[float]) -> list[Best]:
        return [Best(k, w["low"], w["high"], f) for w, f in zip(windows, floors)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard: Shard | None = None
        current = None
        for batch in batches:
            keys = list(zip(batch.column("shard").to_pylist(), batch.column("asks").to_pylist()))
            begin = 0
            for (number, asks), same in groupby(keys):
                part = batch.slice(begin, sum(1 for _ in same))
                begin += part.num_rows
                if number != current:
                    held, shard, current = [], None, number
                if not asks:
                    held.append(part)
                    continue
                if shard is None:
                    shard, held = Shard(codes, held), []
                out = []
                for anchor, vector in zip(part.drop_columns(["vector"]).to_pylist(), codes.read(part.column("vector"))):
                    if positives:
                        allowed = lambda rows: (shard.labels[rows] == anchor["label"]) & (shard.uids[rows] != anchor["uid"])  # noqa: E731, B023
                    else:
                        allowed = lambda rows: shard.labels[rows] != anchor["label"]  # noqa: E731, B023
                    lists = lists_of(anchor["windows"], anchor["floors"])
                    shard.walk(vector, allowed, lists)
                    for place, best in enumerate(lists):
                        for score, order_id, row in zip(best.scores.tolist(), best.ids.tolist(), best.rows.tolist()):
                            out.append((anchor["uid"], place, int(shard.uids[row]), order_id, score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOUND_TYPES)], names=_FOUND_NAMES)

    return run


_FOUND_NAMES = ["anchor", "place", "uid", "order_id", "score"]
_FOUND_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_FOUND = "anchor bigint, place int, uid bigint, order_id bigint, score bigint"
_SENT = "shard bigint, uid bigint, label bigint, vector binary, windows array<struct<low:bigint,high:bigint>>, floors array<bigint>"
_WINDOW = "struct<low:bigint,high:bigint>"


def _ask(index: Index, anchors: DataFrame, k: int, positives: bool) -> DataFrame:
    """Send anchors to their shards and read the lists they find there."""
    rows = index.rows.select(
        "shard", F.lit(False).alias("asks"), "code1", "code2", "uid", "order_id", "label", "vector",
        F.lit(None).cast(f"array<{_WINDOW}>").alias("windows"), F.lit(None).cast("array<bigint>").alias("floors"),
    )
    none = F.lit(None)
    asking = anchors.select(
        "shard", F.lit(True).alias("asks"), none.cast("int").alias("code1"), none.cast("int").alias("code2"), "uid",
        none.cast("bigint").alias("order_id"), "label", "vector", "windows", "floors",
    )
    # shards nobody asks are not read by a task: only those that meet an anchor are sent
    asked = rows.join(anchors.select("shard").distinct(), "shard", "left_semi").unionByName(asking)
    ordered = asked.repartition("shard").sortWithinPartitions("shard", "asks", "code1", "code2", "uid")
    return bounded(ordered).mapInArrow(_scan(index.codes, k, positives), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each list, with their rank."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "order_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, anchors: DataFrame, k: int, positives: bool, name: str) -> DataFrame:
    """Per anchor (shard, uid, label, vector, windows) and window: the first k rows, with their rank.

    The home shard's k-th score is a floor for all the others, and only shards
    with a bound at or above the smallest floor of an anchor are asked.
    """
    unknown = F.transform("windows", lambda w: w["low"])
    home = scratch(_ask(index, anchors.withColumn("floors", unknown), k, positives), f"{name}-home")
    full = home.groupBy("anchor", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    floors = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "floor"))).alias("known"))
    floor = F.transform(
        "windows",
        lambda w, i: F.when(w["low"] > w["high"], F.lit(MOST)).otherwise(
            F.greatest(w["low"], F.coalesce(F.try_element_at("known", i.cast("int")), w["low"]))
        ),
    )
    ready = anchors.join(floors.withColumnRenamed("anchor", "uid"), "uid", "left").withColumn("floors", floor)
    sent = scratch(
        bounded(ready.select("shard", "uid", "label", "vector", "windows", "floors")).mapInArrow(_route(index), _SENT), f"{name}-sent"
    )
    return scratch(_first(home.unionByName(_ask(index, sent, k, positives)), k), name)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    shard_components: int = SHARD_COMPONENTS,
) -> DataFrame:
    """Per anchor and each of its first `positives` rows of the same label: the first `negatives` rows of other labels
    whose score lies between `low` and `high` percent of the positive's score.

    `vectors` has vec_id, label and embedding; a score is the inner product of floor(scale * x).
    """
    spark = vectors.sparkSession
    index = build(integer_vectors(vectors, anchor, scale), shard_components=shard_components)
    if index is None:
        return spark.createDataFrame([], RESULT)
    whole = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    anchors = index.rows.where("anchor").select("shard", "uid", "label", "vector", "vec_id")
    found = search(index, anchors.withColumn("windows", whole), positives, True, "negatives-positives")
    ids = index.rows.select("uid", "vec_id")

    def with_id(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn(name, F.when(F.col("order_id") != NO_ID, F.col("order_id")))

    of_anchor = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "order_id"))).alias("ps"))
    # 100 times a score within the window is at least low times and at most high times the positive's
    def percent(p: Column, share: int) -> Column:
        return p["score"].cast("decimal(20,0)") * share / 100

    windows = F.transform(
        "ps",
        lambda p: F.struct(
            F.ceil(percent(p, low)).cast("bigint").alias("low"), F.floor(percent(p, high)).cast("bigint").alias("high")
        ),
    )
    asking = anchors.join(of_anchor.withColumnRenamed("anchor", "uid"), "uid").withColumn("windows", windows)
    asking = scratch(asking, "negatives-windows")
    hard = search(index, asking.drop("ps", "vec_id"), negatives, False, "negatives-found")
    pairs = asking.select(
        F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("ps").alias("place", "p")
    ).select("anchor", "place", "anchor_id", F.col("p.score").alias("positive_score"), F.col("p.order_id").alias("positive_order"))
    return (
        with_id(hard, "negative_id")
        .join(pairs, ["anchor", "place"])
        .select(
            "anchor_id",
            F.when(F.col("positive_order") != NO_ID, F.col("positive_order")).alias("positive_id"),
            F.col("rank").cast("int").alias("rank"),
            "negative_id",
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
