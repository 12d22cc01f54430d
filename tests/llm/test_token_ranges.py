"""Random access to the token store: the same ids, from the named blocks only."""

import random

import numpy as np
import pytest

from panelwise.llm import queries, tokens


@pytest.fixture(scope="module")
def store(spark):
    r = random.Random(3)
    texts = [(i, " ".join(f"w{r.randint(0, 9999)}" for _ in range(r.randint(0, 12_000)))) for i in range(160)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(6)
    blocks = tokens.write_tokens(docs, queries.TOKENIZER, queries.END_ID)
    return blocks, tokens.block_index(blocks)


def test_index_places_every_block(store):
    blocks, index = store
    rows = sorted(map(tuple, index.select("at", "n_ids", "shard", "block").collect()))
    assert len(rows) == blocks.count() > 20 and rows[0][0] == 0
    assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:]))


def test_ranges_equal_the_whole_store(store):
    blocks, index = store
    rows = sorted(blocks.collect(), key=lambda r: (r.shard, r.block))
    every = np.concatenate([tokens.unpack(r.packed, r.width, 0, r.n_ids) for r in rows])
    r = random.Random(5)
    places = [(0, 1), (0, len(every)), (len(every) - 1, 5), (len(every), 3), (7_999, 2)]
    for a, n in places + [(r.randrange(len(every)), r.choice([1, 50, 20_000])) for _ in range(12)]:
        assert tokens.read_range(blocks, a, n, index).tolist() == every[a : a + n].tolist()
    assert tokens.read_range(blocks, 10, 5).tolist() == every[10:15].tolist()


def test_scan_reads_the_named_blocks_alone(spark, store):
    blocks, index = store
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = tokens.blocks_of_range(blocks, index, 100_000, 10)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(shard," in plan and "GreaterThanOrEqual(block," in plan and "LessThanOrEqual(block," in plan
