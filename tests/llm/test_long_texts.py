"""Texts of many megabytes in the operators that compare them: bounded memory, same results."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from panelwise.llm import decontaminate, jaccard, words


def peak(work):
    """Result, and the most megabytes held at once."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def prose(n, seed=1):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, 50_000, n))


def test_hashes_do_not_depend_on_the_stretch(monkeypatch):
    r = random.Random(3)
    texts = pa.array(["", None, "x" * 500, *(" ".join("ab"[r.random() < 0.5] * r.randint(1, 30) for _ in range(r.randint(0, 50))) for _ in range(40))])
    whole = words.word_hashes(texts)
    monkeypatch.setattr(words, "STRETCH", 64)
    for a, b in zip(whole, words.word_hashes(texts)):
        assert (a == b).all()


def test_words_of_a_long_text():
    text = pa.array([prose(3_000_000)])
    (hashes, _, _), mb = peak(lambda: words.word_hashes(text))
    assert len(hashes) == 3_000_000 and mb < 400


def test_benchmark_items_at_both_ends_of_a_long_text():
    item, other = prose(60, 5), prose(9, 6)
    index = decontaminate.Benchmark([7, 8], [item, other])
    text = pa.array([f"{item} {prose(1_000_000)} {other} {prose(500_000, 2)} {item}"])
    found, mb = peak(lambda: index.matches(text))
    assert sorted((i, s) for i, s, _ in found[0]) == [(7, 0), (8, 1_000_060)] and mb < 500


def test_a_long_text_full_of_a_common_passage():
    item = prose(30, 5)
    index = decontaminate.Benchmark([1], [item])
    text = pa.array([" ".join([" ".join(item.split()[:6])] * 60_000) + " " + item])
    found, mb = peak(lambda: index.matches(text))
    assert [(i, round(s, 3)) for i, _, s in found[0]] == [(1, 1.0)] and mb < 500


@pytest.mark.parametrize("limit", [3, 7, 1 << 14])
def test_runs_of_starts_give_the_same_windows(monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "RUN_STARTS", limit)
    starts = np.array([0, 1, 2, 3, 9, 10, 40, 41, 90])
    parts = decontaminate.runs(starts, 5)
    assert np.concatenate(parts).tolist() == starts.tolist() and all(len(p) <= limit for p in parts)
    assert all(p[-1] - p[0] < 5 * len(p) for p in parts) and decontaminate.runs(starts[:0], 5) == []


def sketches(texts):
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    return pa.Table.from_batches(list(jaccard._sketch(iter([batch]))))


def test_long_unlike_texts_do_not_share_bands():
    """MinHash values of texts with far more than 65,536 shingles differ as those of short ones do."""
    made = sketches([prose(300_000, seed) for seed in range(4)])
    lanes = np.array(made.column("bands").to_pylist(), "<i8").view(np.uint16)
    for i in range(4):
        for j in range(i):
            assert (lanes[i] == lanes[j]).mean() < 0.05


def test_strays_leave_no_pairs_of_unlike_texts():
    """Texts that share one band and nothing else are compared in a block, and no pair of them is written."""
    r = np.random.default_rng(1)
    n = 300
    bands = r.integers(0, 1 << 62, (n, jaccard.BANDS))
    bands[:, 3] = 5
    near = bands[7].copy()
    near[20:22] = 1
    bands[250] = near  # one pair that is alike, in different homes; it meets first in band 0
    homes = r.integers(0, 9, n) + 1000
    homes[[7, 250]] = 1001, 1002

    def compared(band):
        rows = []
        for stray in (True, False):
            for i in range(n):
                if not stray or homes[i] != 1000:
                    rows.append({"rid": i, "home": int(homes[i]), "main": 1000, "bands": bands[i].tolist(), "stray": stray})
        table = pa.Table.from_pylist(rows)
        out = jaccard._compare_strays((pa.scalar(band), pa.scalar(5), pa.scalar(0), pa.scalar(0)), table)
        return list(zip(out.column("a").to_pylist(), out.column("b").to_pylist()))

    assert compared(3) == [] and compared(0) == [(7, 250)]
