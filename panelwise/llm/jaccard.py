"""N-gram Jaccard join of a table with itself: MinHash, Bayesian pruning, exact verification, classes.

Documents are compared by their sets of five-word shingles; two texts are linked
when the Jaccard similarity is 0.8 or more.

1. Every text is sketched: 112 MinHash values of 16 bits, in 28 bands of four.
   Rows with the same words in the same order are copies and share one sketch.
2. Texts that share a band meet in a bucket. The most central member of a bucket
   (the one with most company over all its buckets) is its centre, and the home of
   a text is the most central of the centres it meets. Near copies share the home.
3. Texts with one home are compared in blocks, bounded in texts and in bytes: a task
   takes two blocks, and nothing but counts of links and the edges of a spanning
   forest leaves it. A home with thousands of texts becomes pairs of blocks for many
   tasks, never pairs of texts. Texts of different homes that share a bucket are
   compared in blocks of their MinHash values, in the first bucket they share; only
   pairs that pruning leaves are written, to be verified.
4. In both, MinHash values are compared 16 at a time. After every step the
   posterior probability that the similarity reaches 0.8 (uniform prior, Beta
   posterior) is looked up, and pairs below the tolerance are dropped; the rest is
   verified on the full shingle sets.
5. Links give components, the classes, and each text's number of links is summed up.

A pair at exactly 0.8 shares no band with probability 4e-7 and is dropped by the
tolerance with at most 1e-5; beyond that the result is exact, with 64-bit shingle
hashes standing for the shingles.

Null texts count as empty. Texts without words are copies of each other and linked
to nothing else; texts of fewer than five words have one shingle. Repeated rows
are copies. Class ids are the smallest document id of the class, null if all are
null. Extra columns are not read, or carried along untouched by `keep_one`. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import SALTS, bounded, col, lookup, scratch, slices, strings, whole_row
from panelwise.llm.words import mix, shingle_set, shingles, word_hashes

BANDS, ROWS = 28, 4
LANES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK_TEXTS = 512
BLOCK_BYTES = 1 << 24
VOCABULARY = 4096
_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(1, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(1, 1 << 63, LANES, dtype=np.uint64)


def linked(shared, size_a, size_b):
    """Whether the similarity reaches 0.8, in whole numbers: shared / (a + b - shared) >= 4 / 5."""
    return 9 * shared >= 4 * (size_a + size_b)


def least_matches(lanes: int = LANES, step: int = STEP, threshold: float = 0.8, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches with which a pair stays a candidate), for each step.

    With a uniform prior and m matches of n the similarity is Beta(m + 1, n - m + 1),
    and P(similarity >= t) equals P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, lanes + 1, step):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def copy_key(hashes: np.ndarray) -> bytes:
    """128-bit key of a text's words in order."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            hashes, _, first = word_hashes(strings(part.column("text")))
            of, begin = shingles(hashes, first)
            there = np.flatnonzero(np.diff(begin))
            lanes = np.empty((LANES, len(there)), np.uint16)
            if len(there):
                value, at = np.empty_like(of), begin[:-1][there]
                for lane in range(LANES):
                    np.multiply(of, _FACTORS[lane], out=value)
                    np.add(value, _SHIFTS[lane], out=value)
                    # the minimum of many shingles is small: hashed again, its bits are even whatever their number
                    lanes[lane] = mix(np.minimum.reduceat(value, at)) >> np.uint64(48)
            bands = np.ascontiguousarray(lanes.T).view("<i8")
            sketch: list[list[int] | None] = [None] * len(first[1:])
            for i, row in zip(there.tolist(), bands.tolist()):
                sketch[i] = row
            keys = [copy_key(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"]
            )


def _doc(name: str):
    """Document id that can be joined on, null included."""
    return F.coalesce(F.col(name).cast("string"), F.lit("-"))


def _keyed(rows: DataFrame) -> DataFrame:
    """(row, doc, key) of rows (row, doc_id), the text being a field of row; within a task repeated rows of a document pass once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            text = pc.struct_field(batch.column("row"), [at])
            for part in slices(pa.RecordBatch.from_arrays([*batch.columns, text], names=["row", "doc", "text"])):
                hashes, _, first = word_hashes(strings(part.column("text")))
                keys = [copy_key(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
                keep = []
                for pair in zip(part.column("doc").to_pylist(), keys):
                    keep.append(pair not in seen)
                    seen.add(pair)
                if len(seen) > 200_000:
                    seen.clear()
                out = pa.RecordBatch.from_arrays([part.column("row"), part.column("doc"), pa.array(keys, pa.binary())], names=["row", "doc", "key"])
                yield out.filter(pa.array(keep))

    given = rows.select("row", _doc("doc_id").alias("doc"))
    at = given.schema["row"].dataType.fieldNames().index("text")
    schema = T.StructType([given.schema["row"], given.schema["doc"], T.StructField("key", T.BinaryType())])
    return given.mapInArrow(run, schema)


def _ints(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), "<i8").reshape(len(column), -1)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            hashes, _, first = word_hashes(strings(part.column("text")))
            made = [shingle_set(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
            size = pa.array(list(map(len, made)), pa.int64())
            columns = [part.column("rid"), pa.array(made, pa.binary()), part.column("bands"), size]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "shingles", "bands", "bytes"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            keep.append(bool(linked(int((both[1:] == both[:-1]).sum()), len(x), len(y))))
        rows = pa.array(np.flatnonzero(np.array(keep, bool)))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], names=["a", "b"])


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one block with all of another, without holding them densely."""
    vocabulary = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    for begin in range(0, len(vocabulary), VOCABULARY):
        some = vocabulary[begin : begin + VOCABULARY]
        tables = []
        for sets in (a, b):
            table = np.zeros((len(sets), len(some)), np.float32)
            for row, s in zip(table, sets):
                mine = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], "right")]
                at = np.searchsorted(some, mine)
                row[at[some[at] == mine]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def likely(a: np.ndarray, b: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of two blocks (of those alive) Bayesian pruning leaves, comparing their MinHash values step by step."""
    matches, done = np.zeros((len(a), len(b)), np.int16), 0
    alive = np.ones_like(matches, bool) if alive is None else alive.copy()
    for n, least in least_matches():
        for lane in range(done, n):
            matches += a[:, lane, None] == b[None, :, lane]
        done = n
        alive &= matches >= least
        if not alive.any():
            break
    return alive


def forest(links: np.ndarray, rids: np.ndarray) -> list[tuple[int, int]]:
    """Edges (rid, smallest rid of its component) of a symmetric table of links."""
    label = np.arange(len(rids))
    while True:
        near = np.where(links, label[None, :], len(rids)).min(axis=1, initial=len(rids))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return [(int(rids[i]), int(rids[j])) for i, j in enumerate(label) if i != j]
        label = new


def _compare_blocks(key: tuple, batch: pa.Table) -> pa.Table:
    """Per text of two blocks of a home: its links into the other block (or its own), and an edge of the forest."""
    low, high = key[1].as_py(), key[2].as_py()
    batch = batch.sort_by("rid")
    rids, blocks = batch.column("rid").to_numpy(), batch.column("block").to_numpy()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column("shingles")]
    lanes = np.ascontiguousarray(_ints(batch.column("bands").combine_chunks())).view(np.uint16)
    sizes = np.array([len(s) for s in sets])
    left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    links = np.zeros((len(rids), len(rids)), bool)
    pairs = likely(lanes[left], lanes[right])
    rows, columns = np.flatnonzero(pairs.any(axis=1)), np.flatnonzero(pairs.any(axis=0))
    if len(rows) and len(columns):
        i, j = left[rows], right[columns]
        shared = shared_counts([sets[x] for x in i], [sets[x] for x in j])
        found = linked(shared, sizes[i][:, None], sizes[j][None, :]) & pairs[np.ix_(rows, columns)]
        links[np.ix_(i, j)] = found
        links |= links.T
    np.fill_diagonal(links, False)
    edges = dict(forest(links, rids))
    counts = links.sum(axis=1)
    keep = np.flatnonzero(counts)
    return pa.table(
        {
            "rid": pa.array(rids[keep], pa.int64()),
            "links": pa.array(counts[keep], pa.int64()),
            "edge": pa.array([edges.get(int(r)) for r in rids[keep]], pa.int64()),
        }
    )


def _compare_strays(key: tuple, batch: pa.Table) -> pa.Table:
    """Pairs of a block of strays and a block of members of a bucket that pruning leaves, if they meet here first.

    A pair meets in every bucket it shares. It counts in the first, and there a pair
    of strays, who are members too, counts from the smaller one.
    """
    band = key[0].as_py()
    batch = batch.sort_by("rid")
    rids, homes = batch.column("rid").to_numpy(), batch.column("home").to_numpy()
    bands = _ints(batch.column("bands").combine_chunks())
    stray = batch.column("stray").to_numpy(zero_copy_only=False)
    main = batch.column("main").to_numpy()[:1]
    left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
    alive = homes[left][:, None] != homes[right][None, :]
    alive &= (homes[right] == main)[None, :] | (rids[left][:, None] < rids[right][None, :])
    for earlier in range(band):
        if not alive.any():
            break
        alive &= bands[left, earlier][:, None] != bands[right, earlier][None, :]
    if alive.any():
        lanes = np.ascontiguousarray(bands).view(np.uint16)
        alive = likely(lanes[left], lanes[right], alive)
    i, j = np.nonzero(alive)
    a, b = rids[left[i]], rids[right[j]]
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(rid, comp) for every end of a link (a, b): comp is the smallest rid of its connected component.

    Every round takes the smallest label among the neighbours and then the label of
    that label, so long chains shrink by doubling; labels are written between rounds.
    """
    ends = scratch(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "ends")
    labels = scratch(ends.groupBy(F.col("a").alias("rid")).agg(F.min("b").alias("low")).select("rid", F.least("rid", "low").alias("comp")), "labels")
    # a text that many are linked to is spread by the other end
    spread = ends.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    while True:
        near = lookup(spread, "b", "salt", labels.select(F.col("rid").alias("b"), "comp"))
        near = near.groupBy(F.col("a").alias("rid")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "rid").select("rid", F.col("comp").alias("old"), F.least("comp", "near").alias("new"))
        jump = step.join(labels.select(F.col("rid").alias("new"), F.col("comp").alias("far")), "new")
        moved = scratch(jump.select("rid", "old", F.least("new", "far").alias("comp")), "labels")
        labels = moved.select("rid", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


class Join:
    """The join of one table with itself; holds its tables in the shared folder."""

    def __init__(self, docs: DataFrame):
        texts = bounded(docs).select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text"))
        self.rows = scratch(
            texts.mapInArrow(_sketch, "doc_id bigint, key binary, bands array<bigint>").withColumn("row_id", F.monotonically_increasing_id()),
            "sketches",
        )
        # copies share their words, hence their sketch
        self.texts = scratch(
            self.rows.groupBy("key")
            .agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
            .withColumn("rid", F.monotonically_increasing_id()),
            "texts",
        )
        self._buckets()
        self._find_sets(texts)
        self._link()

    def _buckets(self) -> None:
        """Members of buckets with two texts or more, and every text's home."""
        salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).alias("salt")
        every = self.texts.where("bands is not null").select("rid", F.posexplode("bands").alias("band", "value"))
        every = every.select("rid", F.struct("band", "value").alias("bucket"), salt)
        shared = scratch(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
        met = scratch(lookup(every, "bucket", "salt", shared), "met")
        company = met.join(met.groupBy("rid").agg(F.sum("n").alias("company")), "rid")
        company = scratch(company.select("bucket", "salt", "rid", F.struct("company", "rid").alias("rank")), "company")
        centre = scratch(company.groupBy("bucket").agg(F.max("rank").alias("centre")), "centres")
        homes = lookup(company, "bucket", "salt", centre).groupBy("rid").agg(F.max("centre").alias("home"))
        self.homes = scratch(homes.select("rid", F.col("home.rid").alias("home")), "homes")
        self.members = scratch(met.select("bucket", "salt", "rid").join(self.homes, "rid"), "members")

    def _find_sets(self, texts: DataFrame) -> None:
        """Full shingle sets of the texts in buckets, each from one row that holds the text."""
        wanted = self.texts.join(self.homes, "rid").select("rid", "key", _doc("first_doc").alias("doc"), "bands")
        rows = texts.select("doc_id", F.struct("text").alias("row"))
        one = _keyed(rows).join(wanted, ["key", "doc"]).dropDuplicates(["key", "doc"]).select("rid", "row.text", "bands")
        self.sets = scratch(one.mapInArrow(_sets, "rid bigint, shingles binary, bands array<bigint>, bytes bigint"), "sets")

    def _across(self) -> DataFrame:
        """Pairs (a, b) of texts with different homes that share a bucket and that Bayesian pruning leaves, each once.

        Strays, the members of a bucket outside the home of most of it, meet all
        members in pairs of blocks, and only what is left is written.
        """
        there = self.members.groupBy("bucket", "home").agg(F.count(F.lit(1)).alias("n"))
        sums = there.groupBy("bucket").agg(F.count(F.lit(1)).alias("homes"), F.sum("n").alias("all"), F.max(F.struct("n", "home")).alias("most"))
        blocks = lambda n: F.ceil(n / BLOCK_TEXTS).cast("int")
        sums = sums.where("homes > 1").select(
            "bucket", F.col("most.home").alias("main"), blocks(F.col("all") - F.col("most.n")).alias("strays"), blocks(F.col("all")).alias("alls")
        )
        mixed = lookup(self.members, "bucket", "salt", scratch(sums, "mixed")).join(self.texts.select("rid", "bands"), "rid")

        def dealt(stray: bool) -> DataFrame:
            mine, others = ("strays", "alls") if stray else ("alls", "strays")
            block = F.pmod(F.xxhash64("rid"), F.col(mine)).cast("int").alias("mine")
            rows = mixed.where("home <> main") if stray else mixed
            rows = rows.select("*", block, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("other"))
            low, high = ("mine", "other") if stray else ("other", "mine")
            return rows.select(
                F.col("bucket.band").alias("band"), F.col("bucket.value").alias("value"), F.col(low).alias("low"), F.col(high).alias("high"),
                "rid", "home", "main", "bands", F.lit(stray).alias("stray"),
            )

        both = dealt(True).unionByName(dealt(False))
        return both.groupBy("band", "value", "low", "high").applyInArrow(_compare_strays, "a bigint, b bigint")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that the full sets confirm."""
        full = pairs.join(self.sets.select(F.col("rid").alias("a"), F.col("shingles").alias("set_a")), "a")
        full = full.join(self.sets.select(F.col("rid").alias("b"), F.col("shingles").alias("set_b")), "b")
        return scratch(full.select("a", "b", "set_a", "set_b").mapInArrow(_verify, "a bigint, b bigint"), "links")

    def _link(self) -> None:
        """Links counted by text, and labels of the classes."""
        weights = self.homes.join(self.sets.select("rid", "bytes"), "rid")
        sizes = weights.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
        sizes = scratch(sizes.where("n > 1").select("home", blocks.alias("blocks")), "sizes")
        placed = self.homes.join(sizes, "home").select("rid", "home", "blocks")
        placed = placed.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
        meet = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        meet = meet.select("rid", "home", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        inside = meet.join(self.sets, "rid").groupBy("home", "low", "high").applyInArrow(_compare_blocks, "rid bigint, links bigint, edge bigint")
        inside = scratch(inside, "inside")
        across = self._verified(scratch(self._across(), "across"))
        edges = inside.where("edge is not null").select(F.col("rid").alias("a"), F.col("edge").alias("b"))
        self.labels = components(edges.unionByName(across))
        ends = across.select(F.explode(F.array("a", "b")).alias("rid"), F.lit(1).cast("bigint").alias("links"))
        self.counts = inside.select("rid", "links").unionByName(ends).groupBy("rid").agg(F.sum("links").alias("links"))

    def classes(self) -> DataFrame:
        """Per text: key, class_id, n_links, n_copies, class_size."""
        known = self.texts.select("rid", "key", "first_doc", "copies").join(self.labels, "rid", "left")
        known = scratch(known.withColumn("comp", F.coalesce("comp", "rid")).join(self.counts, "rid", "left"), "known")
        of_class = known.groupBy("comp").agg(F.min("first_doc").alias("class_id"), F.sum("copies").alias("class_size"))
        return known.join(scratch(of_class, "classes"), "comp").select(
            "key", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.col("copies").alias("n_copies"), "class_size"
        )


def jaccard_join(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id, n_links (other texts with similarity 0.8 or more), n_copies, class_size."""
    join = Join(docs)
    rows = join.rows.select("doc_id", "key", F.pmod("row_id", F.lit(SALTS)).alias("salt"))
    return lookup(rows, "key", "salt", join.classes()).select("doc_id", "class_id", "n_links", "n_copies", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, as it is: of its first text (smallest document id) one row."""
    join = Join(docs)
    known = join.texts.select("rid", "key", "first_doc").join(join.labels, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    first = known.groupBy("comp").agg(F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "rid", "key")).alias("t"))
    first = scratch(first.select("t.key", _doc("t.first_doc").alias("doc")), "kept")

    rows = docs.select(whole_row(docs).alias("row"), col("doc_id").cast("bigint").alias("doc_id"))
    one = _keyed(rows).join(first, ["key", "doc"])
    return one.dropDuplicates(["key", "doc"]).select("row.*")
