"""Conversation repair, prefix trie and vector graph against brute force, SQL twins and odd tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import rows_of, twin, write  # noqa: E402

from placewise.llm import prefix_trie, turn_repair, vector_graph  # noqa: E402
from placewise.llm.queries import QUERIES  # noqa: E402
from placewise.llm.sql import ORACLE_SQL  # noqa: E402

DATA = Path("/root/testdata")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
TURNS = "conv_id long, turn long, role string, text string, step int, depth int, place int, fault string, conv string, n int, block int"
EXTRA = (1, 2, 3, "f", "c", 4, 5)

# -- repair -------------------------------------------------------------------------


def cheapest(rows: list[tuple[str, bool, bool]], insert: int) -> tuple[int, str, str]:
    """(cost, edits, initials after them) by trying every string of edits with at most two inserts in a place."""
    found = []
    for picks in itertools.product("DKua", repeat=len(rows)):
        spent, kept = 0, []
        for (initial, must_go, cut), pick in zip(rows, picks, strict=True):
            if pick == "D":
                spent += 2
                kept.append(("D", ""))
                continue
            if must_go or (pick == initial):
                break
            spent += (0 if pick == "K" else 1) + (5 if cut else 0)
            kept.append(("K", initial) if pick == "K" else ("R", pick))
        else:
            for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
                roles = "".join(g + k[1] for g, k in zip(gaps, [*kept, ("", "")], strict=True))
                body = roles.removeprefix("s")
                if (roles == "" or body) and body == "ua" * (len(body) // 2):
                    edits = "".join("I" * len(g) + k[0] for g, k in zip(gaps, [*kept, ("", "")], strict=True))
                    found.append((spent + insert * sum(map(len, gaps)), edits, roles))
    return min(found)


@pytest.mark.parametrize("insert", [5, 1])
def test_repair_is_the_cheapest_and_least(monkeypatch, insert):
    monkeypatch.setattr(turn_repair, "INSERT", insert)
    fresh = {key: turn_repair._choices(*key) for key in turn_repair.CHOICES}
    monkeypatch.setattr(turn_repair, "CHOICES", fresh)
    rng, names = random.Random(insert), {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    inserted = 0
    for _ in range(120):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        repair = turn_repair.Repair()
        for initial, must_go, cut in rows:
            repair.add((None, names[initial], "", "x"), initial, must_go, cut)
        found = list(repair.edits())
        _, edits, roles = cheapest(rows, insert)
        assert "".join(e for e, _, _ in found) == edits
        assert "".join(r[0] for _, r, _ in found if r) == roles
        inserted += edits.count("I")
    assert inserted > 0 if insert == 1 else inserted == 0


def test_giant_conversations_go_through_files(monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["user", "assistant", "tool"]), rng.choice(["", "", "truncated", "blank"])) for _ in range(3000)]

    def run(held: int, batch: int) -> list[tuple]:
        monkeypatch.setattr(turn_repair, "HELD", held)
        table = pd.DataFrame(
            [("7", False, False, i, False, role, f"text {i}", fault) for i, (role, fault) in enumerate(rows)],
            columns=["conv", "no_id", "lost", "at", "no_turn", "role", "text", "fault"],
        )
        parts = [table.iloc[i : i + batch] for i in range(0, len(table), batch)]
        return [tuple(r) for df in turn_repair._repair_rows(parts) for r in df.itertuples(index=False)]

    plain = run(1 << 30, 10_000)
    assert run(500, 70) == plain
    assert [r[5] for r in plain if r[3] not in (None, "I")] == [f"text {i}" for i in range(3000)]


def said(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    pick = lambda: (rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice(["Yes.", "no", " \n", "", None, "Why?  ", "<é> !"]))
    rows = [(rng.choice([0, 1, 2, 100, 101, 205, 300, -3, 17]), rng.choice([None, 0, 1, 2, 3, 5, 9]), *pick()) for _ in range(n)]
    rows += [(400 + i % 7, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for i in range(14) for t in range(i % 5)]
    return [(*r, *EXTRA) for r in rows]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("turns")
    rows = said(160, 1)
    hot = [(500, i, ("user", "assistant")[i % 2], "Same." if i % 3 else f"Turn {i}", *EXTRA) for i in range(150)]
    nulls = [(None, i % 3, "user", "No id.", *EXTRA) for i in range(4)]
    same = [(c, i, "user", f"Shared {i}.", *EXTRA) for c in range(600, 640) for i in range(3)]
    write(spark.createDataFrame(rows + rows[:20] + hot + nulls + same, TURNS), path, "conversations")
    return str(path)


@pytest.mark.parametrize("block", [1 << 16, 3])
@pytest.mark.parametrize("name", ["op11_turn_repair", "op13_prefix_trie"])
def test_odd_conversations(spark, odd, monkeypatch, name, block):
    if block == 3 and name.startswith("op11"):
        pytest.skip("no blocks")
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    assert rows_of(QUERIES[name](spark, odd)) == twin(ORACLE_SQL[name], conversations=f"{odd}/conversations.parquet/*.parquet")


def test_digests_of_runs_are_those_of_whole_lists(monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_RUN", 4)
    rows = [(1, 2, 3, i) for i in range(-5, 30)] + [(1, 2, 4, 7), (2, 0, 0, 1), (2, 0, 0, 10)]
    names = ["depth", "p1", "p2", "conv_id"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 9])], names=names) for i in range(0, len(rows), 9)]
    found = [r for b in prefix_trie._digests(prefix_trie._runs(batches)) for r in zip(*b.to_pydict().values())]
    wanted = {}
    for *key, i in rows:
        wanted.setdefault(tuple(key), []).append(str(i))
    assert found == [(*k, hashlib.sha256(",".join(v).encode()).hexdigest()) for k, v in wanted.items()]


# -- vectors ------------------------------------------------------------------------


def answers(df) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list] = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def exact(vectors: dict[int, np.ndarray], query: int, k: int) -> list[tuple[int, float]]:
    ranked = sorted((-float(v @ vectors[query]), i) for i, v in vectors.items() if i != query and len(v) == len(vectors[query]))
    return [(i, -s) for s, i in ranked[:k]]


@needs_data
@pytest.mark.parametrize("shard_rows", [16_384, 450])
def test_recall(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", shard_rows)
    rows = spark.read.parquet(str(DATA / "sf0.1" / "embeddings.parquet")).collect()
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in rows}
    found = answers(QUERIES["op12_vector_graph"](spark, str(DATA / "sf0.1")))
    assert set(found) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, answer in found.items():
        assert len(answer) == 20 and q not in dict(answer)
        assert all(abs(s - vectors[i] @ vectors[q]) < 1e-12 for i, s in answer)
        assert answer == sorted(answer, key=lambda a: (-a[1], a[0]))
        hits += len({i for i, _ in answer} & {i for i, _ in exact(vectors, q, 20)})
    assert hits / 20 / len(found) >= 0.95


def test_long_vectors_of_unequal_length_are_found(spark):
    # The largest inner product, not the nearest direction.
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=12) * rng.uniform(0.1, 4) for i in range(700)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    found = answers(vector_graph.nearest(df, F.col("vec_id") % 20 == 0))
    hits = sum(len({i for i, _ in a} & {i for i, _ in exact(vectors, q, 20)}) for q, a in found.items())
    assert len(found) == 35 and hits / 700 >= 0.95


def test_odd_vectors(spark):
    rng = np.random.default_rng(6)
    plain = [(i, rng.normal(size=4).round(1).tolist()) for i in range(1, 30)]
    same = [(100 + i, [1.0, 0.0, 2.0, 0.0]) for i in range(60)]
    short = [(200, [3.0, 4.0]), (201, [1.0, 1.0]), (202, [-1.0, 0.5])]
    bad = [(220, None), (240, [0.0] * 4), (260, [1.0, None, 1.0, 1.0]), (280, [float("nan"), 1.0, 1.0, 1.0]),
           (300, [float("inf"), 1.0, 1.0, 1.0]), (320, []), (None, [1.0, 1.0, 1.0, 1.0])]
    rows = plain + same + short
    schema = "vec_id long, embedding array<double>, shard int, dim int, ids string, k1 int, score int, rank int"
    extra = (1, 2, "x", 3, 4, 5)
    df = spark.createDataFrame([(*r, *extra) for r in [*rows, *bad, *rows[:9], *same[:7]]], schema)
    found = answers(vector_graph.nearest(df, F.col("vec_id") % 20 == 0))
    vectors = {i: np.array(v) for i, v in rows}
    assert set(found) == {20, 100, 120, 140, 200}
    for q, answer in found.items():
        wanted = exact(vectors, q, 20)
        assert [i for i, _ in answer] == [i for i, _ in wanted]
        assert np.allclose([s for _, s in answer], [s for _, s in wanted])
    assert len(found[200]) == 2
    nothing = df.where("vec_id IS NULL OR vec_id >= 220")
    assert vector_graph.nearest(nothing, F.col("vec_id") % 20 == 0).count() == 0
    one = df.where("vec_id = 100")
    assert vector_graph.nearest(one, F.col("vec_id") % 20 == 0).count() == 0
