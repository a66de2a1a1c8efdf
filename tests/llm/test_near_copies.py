"""Near dedup groups rows by fingerprint components alone, as brute force does."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import words  # noqa: E402

import corpus_pipeline  # noqa: E402
from placewise.llm import simhash  # noqa: E402


def changed(text: str, places: list[int]) -> str:
    found = text.split()
    for p in places:
        found[p] = f"other{p}"
    return " ".join(found)


def bits(a: str, b: str) -> int:
    return (simhash.fingerprint(a, 4) ^ simhash.fingerprint(b, 4)).bit_count()


def ordered(rows) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def kept(spark, rows) -> list[tuple]:
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return ordered((r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect())


def test_groups_do_not_follow_doc_ids(spark):
    rows = [(None, words(60, 1)), (None, words(60, 2)), (7, words(60, 3)), (7, words(60, 4)), (None, words(60, 4).upper())]
    assert kept(spark, rows) == ordered(rows[:4])
    # Null ids with copies of their own.
    twice = rows[:2] * 2
    assert kept(spark, twice) == ordered(rows[:2])


@pytest.mark.parametrize("size", [1, 2, 4])
def test_shingles_of_any_size(size):
    text = words(12, 3)
    found = text.split()
    sums = [0] * 64
    for i in range(len(found) - size + 1):
        h = simhash.xxhash.xxh64_intdigest(" ".join(found[i : i + size]).encode(), 42)
        for b in range(64):
            sums[b] += 1 if h >> b & 1 else -1
    assert simhash.fingerprint(text, size) == sum(1 << b for b in range(64) if sums[b] > 0)


def least_linked(n: int, links: list[tuple[int, int]]) -> set[int]:
    label = list(range(n))
    for _ in range(n):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return set(label)


def test_a_large_group_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = words(150, 5)
    texts = [changed(base, rng.choice(150, rng.integers(1, 4), replace=False).tolist()) for _ in range(120)]
    texts += [words(80, 100 + i) for i in range(30)]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if bits(texts[i], texts[j]) <= 4]
    assert len(near) > 100
    assert {r[0] for r in kept(spark, list(enumerate(texts)))} == least_linked(len(texts), near)
