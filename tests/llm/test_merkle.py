"""The Merkle manifest against a plain version, also over several rounds of blocks, and its edge cases."""

import hashlib
import random
import zlib

import pytest

from panelwise.llm import merkle

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string, key string, position int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes, place):
    """Root over the nodes and the siblings on the way up from a place, as runs with the place in them."""
    runs = []
    while len(nodes) > 1:
        first = place - place % 3
        runs.append((nodes[first : first + 3], place % 3))
        nodes = [h(nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        place //= 3
    return nodes[0], runs


def plain(rows):
    """The manifest, one row after the other."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        leaves[s] = [leaf(r, r[4]) for r in by_source[s]]
    subroots = [climb(leaves[s], 0)[0] for s in order]
    out = []
    for i, s in enumerate(order):
        for place, row in enumerate(by_source[s]):
            subroot, low = climb(leaves[s], place)
            root, high = climb(subroots, i)
            proof = h(d for run, at in low + high for j, d in enumerate(run) if j != at)
            tampered = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = leaf(row, row[4].replace("\n", "") if tampered else row[4])
            for run, at in low + high:
                folded = h(folded if j == at else d for j, d in enumerate(run))
            out.append((row[0], leaves[s][place], subroot, root, proof, folded, folded == root))
    return out


def made(n, sources, seed=1):
    r = random.Random(seed)
    return [
        (i, r.choice(sources), r.choice(["de", "en", None]), r.randint(0, 9), "".join(r.choice("aé\n ") for _ in range(r.randint(0, 9))), "k", 1)
        for i in r.sample(range(10 * n), n)
    ]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("levels, n", [(1, 1), (1, 2), (1, 10), (1, 244), (2, 82), (2, 700), (6, 900)])
def test_equal_to_plain_version_over_rounds_of_blocks(spark, levels, n):
    docs = made(n, [None, "", "b", "é", "a"] + ["hot"] * 4)
    got = merkle.manifest(spark.createDataFrame(docs, COLUMNS).repartition(5), levels)
    assert rows(got) == sorted(plain(docs), key=repr)


def test_many_sources(spark):
    docs = made(120, [f"s{i}" for i in range(60)])
    assert rows(merkle.manifest(spark.createDataFrame(docs, COLUMNS), 1)) == sorted(plain(docs), key=repr)


def test_nulls_repeated_rows_and_long_texts(spark):
    docs = [
        (None, None, None, None, None, None, None),
        (None, "a", None, None, "x\ny", "k", 1),
        (1, "a", "de", 3, "x\ny", "k", 1),
        (1, "a", "de", 3, "x\ny", "k", 1),
        (1, "a", "de", 4, "", "k", 1),
        (2, "a", "de", 3, "line\n" * 400_000, "k", 1),
    ]
    assert rows(merkle.manifest(spark.createDataFrame(docs, COLUMNS), 1)) == sorted(plain(docs), key=repr)
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).count() == 0


def test_partial_witnesses_grow_with_later_siblings():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    state = merkle.Appender()
    sizes = []
    for d in digests:
        state.append(d)
        sizes.append(len(state.witnesses[0]) // merkle.DIGEST)
    # complete with the third leaf and the ninth; the last two levels need the end
    assert sizes == [0, 0, 2, 2, 2, 2, 2, 2, 4, 4, 4]
    root = state.close(merkle.depth(len(digests)))
    for i, d in enumerate(digests):
        witness = bytes(state.witnesses[i])
        assert merkle.fold(d, witness, i, len(digests)) == (root, len(witness))
        assert merkle.fold(digests[i - 1], witness, i, len(digests))[0] != root
