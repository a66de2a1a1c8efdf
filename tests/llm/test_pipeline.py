"""The corpus pipeline stage by stage against brute force, and on odd and empty tables."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import no_docs, odd_docs, words, write  # noqa: E402

import corpus_pipeline  # noqa: E402
from placewise.llm.common import table, written  # noqa: E402

pytestmark = pytest.mark.skipif(not Path("/opt/tokenizers").exists(), reason="needs the vocabulary files")


def run_stages(spark, docs):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        out[name] = docs
    return out


def test_stages(spark):
    clean = [(i, words(80, i), "en", "s", 0) for i in range(30)]
    copies = [(100 + i, words(80, 500).upper() if i % 2 else words(80, 500), "en", "s", 0) for i in range(6)]
    near = [(200 + i, words(600, 600) + f" tail{i}", "en", "t", 0) for i in range(4)]
    junk = [(300, "too short", "en", "s", 0), (301, "round and round we go and go " * 20, "en", "s", 0), (302, None, "en", None, 0)]
    docs = spark.createDataFrame(clean + copies + near + junk, "doc_id long, text string, lang string, source string, n_chars long")
    out = run_stages(spark, docs)
    ids = {name: Counter(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in out.items()}
    rest = {r[0] for r in clean + copies + near}
    assert set(ids["quality_rules"]) == rest
    assert set(ids["exact_dedup"]) == rest - set(range(100, 105))
    assert set(ids["simhash_near_dedup"]) == {*range(30), 105, 200}
    assert all(df.columns == docs.columns for name, df in out.items() if name != "best_fit_packing")
    packed = out["best_fit_packing"].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == ids["mix_sources"]


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    odd = write(odd_docs(spark), tmp_path / "odd")
    assert corpus_pipeline.run(spark, odd).columns[:2] == ["doc_id", "piece"]
    assert corpus_pipeline.run(spark, odd).count() > 0
    assert corpus_pipeline.run(spark, write(no_docs(spark), tmp_path / "none")).count() == 0
    for name, df in run_stages(spark, table(spark, odd, "documents")).items():
        if name != "best_fit_packing":
            assert df.columns == odd_docs(spark).columns
