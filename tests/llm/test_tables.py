"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import crc, no_docs, odd_docs, odd_rows, rows_of, twin, words, write  # noqa: E402

from placewise.llm import chat, exact, langid, line_crf, line_quality, mixing, packing, sharding, simhash, token_file  # noqa: E402
from placewise.llm.queries import QUERIES  # noqa: E402
from placewise.llm.sql import ORACLE_SQL  # noqa: E402
from placewise.llm.tokens import Encoder, tokenizer_path  # noqa: E402

ROWS = odd_rows()
needs_tokenizers = pytest.mark.skipif(not Path("/opt/tokenizers").exists(), reason="needs the vocabulary files")


@pytest.fixture(scope="module")
def docs(spark):
    return odd_docs(spark).cache()


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    write(docs, path)
    labels = spark.createDataFrame([(5, 1, 0), (9, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    write(labels, path, "labels")
    said = [(1, 0, "user", "a <|im_end|> b\\<\\| ~1"), (1, 1, "assistant", None), (1, 1, "assistant", "<\\|x"), (2, None, None, "n\n"), (None, 0, "u\ns~er", "é<")]
    write(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"), path, "conversations")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    write(no_docs(spark), path)
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), path, "labels")
    write(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), path, "conversations")
    write(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), path, "embeddings")
    return str(path)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_twins(spark, folder, name):
    tables = {t: f"{folder}/{t}.parquet/*.parquet" for t in ("documents", "labels", "conversations")}
    assert rows_of(QUERIES[name](spark, folder)) == twin(ORACLE_SQL[name], **tables)


@needs_tokenizers
@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name.startswith("op7_") else 0)


@needs_tokenizers
@pytest.mark.parametrize(("file", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_whole_texts(file, spaced):
    tool = Encoder(tokenizer_path(file), spaced)
    odd = ["", " ", "a  b", "a \n b", " a", "a ", "\ta\n\nb  ", "x<|endoftext|>y <|endoftext|>", "it's 'll", "éx é", "İx İ",
           "x\x1c y \x1f z", "12 345  6", "a\r\n b", "\x85 q", "ab_c _d", "ΑΣ. ΑΣ", *[r[1] for r in ROWS if r[1]]]
    for text in odd + odd[::-1]:
        assert tool.ids(text) == tool.whole(text)


@needs_tokenizers
def test_token_file(spark, docs, tmp_path):
    read = token_file.token_file(docs, tokenizer_path("byte_bpe_50k.json"), path=str(tmp_path / "ids"))
    tool = Encoder(tokenizer_path("byte_bpe_50k.json"), True)
    end = np.zeros(1, "<u4").tobytes()
    wanted = Counter((r[0], tool.whole(r[1] or "") + end) for r in ROWS)
    found = sorted(read.collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in found) == wanted
    starts = np.cumsum([0, *[r["n_tokens"] for r in found]])
    assert [r["start"] for r in found] == starts[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert ids == sorted(ids)


@needs_tokenizers
def test_blocks_are_narrow_and_counted_as_they_are_made(spark, docs, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 64)
    blocks = token_file.encoded_blocks(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(blocks) > len({b["part"] for b in blocks})
    assert all(len(b["ids"]) == 2 * b["n_ids"] == 2 * sum(b["n_tokens"]) for b in blocks)
    for part in {b["part"] for b in blocks}:
        held = sorted((b for b in blocks if b["part"] == part), key=lambda b: b["start_in_part"])
        assert [b["counts"] is None for b in held] == [True] * (len(held) - 1) + [False]
        counts = np.frombuffer(bytes(held[-1]["counts"]), dtype=np.int64)
        ids = np.frombuffer(b"".join(bytes(b["ids"]) for b in held), dtype="<u2")
        assert (np.bincount(ids, minlength=len(counts)) == counts).all()


def test_code_is_best_and_limited():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 18), (2, 18), (300, 9), (5000, 18)):
        ids = (rng.zipf(1.2, 20_000) % n).astype("<u4")
        lengths = token_file.code_lengths(np.bincount(ids), limit)
        assert lengths.max() <= limit and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
        lookup, top = token_file.decode_table(lengths)
        packed = token_file.pack(ids, token_file.canonical(lengths), lengths)
        assert (token_file.unpack(*packed, len(ids), lookup, top) == ids).all()
    assert token_file.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32])).tolist() == [6, 6, 5, 4, 3, 2, 1]


@needs_tokenizers
def test_packing(spark, docs):
    found = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).collect()
    tool = Encoder(tokenizer_path("word_bpe_49k.json"), False)
    wanted = Counter()
    for r in ROWS:
        ids = tool.whole(r[1] or "") + np.zeros(1, "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 8192)):
            wanted[(r[0], k, at // 4, len(ids[at : at + 8192]) // 4, crc(ids[at : at + 8192]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    check_bins(found)
    whole = packing.sequences(docs, tokenizer_path("word_bpe_49k.json")).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 8192 for r in whole)


def check_bins(rows, capacity=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_in_many_chunks(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("piece_id"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).cast("long").alias("length")
    )
    packed = packing.place(rows, chunk=40).collect()
    assert sorted(r["piece_id"] for r in packed) == list(range(4000))
    assert check_bins(packed) <= 1.02 * -(-sum(r["length"] for r in packed) // 2048)


def test_local_search_empties_bins():
    sizes = np.random.default_rng(0).integers(300, 1100, 3000).tolist()
    plain = packing.Bins(2048)
    plain.best_fit((s, i) for i, s in enumerate(sizes))
    which, offset, fill = packing.pack_lengths(sizes)
    assert which.max() + 1 < len(plain.items)
    assert np.bincount(which, weights=sizes).max() <= 2048


@needs_tokenizers
@pytest.mark.parametrize(("size", "above"), [("0.001", 1), ("0.01", 0)])
def test_swaps_alone_pack_the_given_tables(spark, size, above):
    tool = Encoder(tokenizer_path("word_bpe_49k.json"), False)
    texts = [r["text"] for r in spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet").select("text").collect()]
    sizes = [n for n in ((len(tool.ids(t)) // 4 + 1) % 2048 for t in texts) if n]
    bins = packing.Bins(2048)
    bins.next_fit((s, i) for i, s in enumerate(sizes))
    start, least = len(bins.items), packing.fewest_bins(sizes, 2048)
    bins._climb(least)
    used = [f for f in bins.fill if f]
    assert bins.moves > 0 and len(used) < 0.9 * start and len(used) <= least + above
    assert sorted(e[1] for held in bins.items for e in held) == list(range(len(sizes))) and max(used) <= 2048


def test_packing_of_small_cases():
    rng = np.random.default_rng(1)
    for case in range(100):
        n, capacity = int(rng.integers(1, 60)), int(rng.integers(8, 40))
        sizes = rng.integers(1, capacity, n).tolist()
        which, offset, fill = packing.pack_lengths(sizes, capacity, None if case % 2 else rng.permutation(n))
        for b in range(which.max() + 1):
            held = np.flatnonzero(which == b)
            held = held[np.argsort(offset[held])]
            assert offset[held].tolist() == np.cumsum([0, *[sizes[k] for k in held]])[:-1].tolist()
            assert set(fill[held].tolist()) == {sum(sizes[k] for k in held)} and fill[held[0]] <= capacity
    # Pieces all alike: nothing can be gained, and the search ends at once.
    assert packing.pack_lengths([683] * 8000)[0].max() + 1 == 4000


def test_tiny_pieces_go_on_in_bounded_numbers(spark, monkeypatch):
    monkeypatch.setattr(packing, "OPEN_PIECES", 100)
    rows = spark.range(3000).select(F.col("id").alias("piece_id"), F.lit(1).cast("long").alias("length"))
    packed = packing.place(rows, capacity=64, chunk=500).collect()
    assert sorted(r["piece_id"] for r in packed) == list(range(3000))
    assert check_bins(packed, 64) <= 55


def simhash_slowly(text, k):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + k]) for i in range(max(1, len(found) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_slowly(prints, radius):
    label = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_simhash(spark, docs):
    found = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, 4, 4).collect())
    prints = [simhash_slowly(r[1], 4) for r in ROWS]
    label = components_slowly(prints, 4)
    least = {c: min((r[0] for r, x in zip(ROWS, label) if x == c and r[0] is not None), default=None) for c in set(label)}
    assert found == Counter((r[0], f"{p:016x}", least[c]) for r, p, c in zip(ROWS, prints, label))
    kept = simhash.near_dedup(docs, 4, 4)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least.values())


@pytest.mark.parametrize("blocks", [1, 7])
def test_index_finds_every_link(spark, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROOT", 48 / blocks)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(3)]
    # A dense group: hundreds of fingerprints around one.
    dense = [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(0, 40, 2) for j in range(i)]
    prints = list({int(b) for b in base} | set(near) | set(dense))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    roots = {r["node"]: r["root"] for r in simhash.linked(spark.createDataFrame(signed, "fp long"), 4).collect()}
    values, label = np.array(prints, dtype=np.uint64), np.arange(len(prints))
    while True:
        lower = np.array([label[np.bitwise_count(values ^ v) <= 4].min() for v in values])
        if (lower == label).all():
            break
        label = lower
    found = [roots.get(s[0], s[0]) for s in signed]
    pairs = {(a, b) for a, b in zip(found, label.tolist())}
    assert len(pairs) == len(set(found)) == len(set(label.tolist()))


def test_exact_dedup_keeps_one_of_each(spark, docs):
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    best = {}
    for r in ROWS:
        key = (r[1] or "").encode().lower()
        best[key] = max(best.get(key, -1), -1 if r[0] is None else r[0])
    found = Counter((r["text"] or "").encode().lower() for r in kept.collect())
    assert set(found) == set(best) and set(found.values()) == {1}
    assert Counter(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == Counter(best.values())
    groups = exact.duplicate_groups(docs).collect()
    assert len(groups) == len(ROWS) and sum(r["kept"] for r in groups) == len(best)


def test_exact_dedup_when_all_slots_collide(spark, docs, monkeypatch):
    wanted = rows_of(exact.duplicate_groups(docs))
    monkeypatch.setattr(exact, "WORDS", 1)
    monkeypatch.setattr(exact, "BITS", 1)
    assert rows_of(exact.duplicate_groups(docs)) == wanted


def test_hashes_are_taken_of_survivors_only(spark):
    start = "the same start of sixty-four characters, and then some more of it "
    texts = ["a" * n for n in range(200, 230)]  # no length is shared
    texts += [c * 150 for c in "bcdefghij"]  # one length, no prefix is shared
    texts += [start + "x", start + "y", (start + "x").upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = exact.refined(docs).collect()
    assert len(found) == len(texts)
    assert {r["doc_id"] for r in found if r["_prefix"] is not None} == set(range(30, 42))
    assert {r["doc_id"] for r in found if r["_hash"] is not None} == {39, 40, 41}


def test_boilerplate_goes(spark):
    notice = "This notice stands under every page of the site"
    rows = [(i, words(50, 100 + i) + "\n" + notice, "h", 0) for i in range(40)]
    rows += [(100 + i, notice + "\n" + notice.upper() + "\n" + notice + "  \nown word " + str(i), "h", 0) for i in range(5)]
    # Most words stay, yet fewer than twenty.
    rows += [(110, words(19, 8) + "\n" + notice, "h", 0), (111, words(20, 7) + "\n" + notice, "h", 0)]
    rows += [(200, notice * 3, "other", 0), (201, words(30, 9) + "\n" + notice, None, 0)]
    # Copies of one text count once, however many.
    rows += [(300 + i, words(60, 6), "h", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    verdict = {r["doc_id"]: r for r in line_quality.quality_rules(docs).collect()}
    assert all(verdict[i]["kept"] for i in [*range(40), 111, *range(300, 400)])
    assert not any(verdict[i]["kept"] for i in [*range(100, 105), 110])
    assert verdict[201]["removed_words"] == 0
    kept = {r["doc_id"]: r for r in line_quality.quality_filter(docs).collect()}
    assert set(kept) == {i for i, r in verdict.items() if r["kept"]}
    assert all(kept[i]["text"] == words(50, 100 + i) and kept[i]["n_chars"] == len(kept[i]["text"]) for i in range(40))
    assert kept[201]["text"] == rows[48][1] and kept[201]["n_chars"] == 0


def test_line_limit_follows_the_host(spark):
    """A line in an eighth of the texts goes from a host of any size, one in a twentieth stays."""
    rows = []
    for n, host in ((96, "small"), (960, "large")):
        for i in range(n):
            often, seldom = ["\nan eighth of all"] * (i % 8 == 0), ["\na twentieth of all"] * (i % 20 == 0)
            rows.append((len(rows), words(25, len(rows)) + "".join(often + seldom), host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = {r["doc_id"]: r["removed_words"] for r in line_quality.quality_rules(docs).collect()}
    assert {i for i, n in removed.items() if n} == {i for i, r in enumerate(rows) if "eighth" in r[1]}
    assert set(removed.values()) == {0, 4}


def test_quality_filter_keeps_columns(spark, docs):
    kept = line_quality.quality_filter(docs)
    assert kept.columns == docs.columns
    verdict = Counter(r["doc_id"] for r in line_quality.quality_rules(docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == verdict


def test_native_operators_have_no_python(spark, docs, folder):
    plans = [
        line_quality.quality_rules(docs), line_quality.quality_filter(docs), exact.exact_dedup(docs),
        exact.duplicate_groups(docs), QUERIES["op7_chat_format"](spark, folder), mixing.mixed(docs),
    ]
    for df in plans:
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_reply_trees(spark):
    rows = [
        (1, 1, None, 1.0), (1, 2, 1, 0.5), (1, 3, 2, 0.9), (1, 4, 2, 0.1), (1, 5, 1, 0.4),
        (1, 6, 99, 0.3),  # answers a message that is gone
        (1, 7, 8, 1.0), (1, 8, 7, 1.0),  # a circle
        (2, 1, None, None),
        *[(3, i, i - 1 if i > 1 else None, 0.0) for i in range(1, 38)],
    ]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    found = defaultdict(list)
    for r in chat.reply_paths(messages, branches=2).collect():
        found[(r["tree"], r["leaf"], r["rank"])].append((r["depth"], r["node"]))
    paths = {k: [n for _, n in sorted(v)] for k, v in found.items()}
    assert paths == {(1, 3, 1): [1, 2, 3], (1, 5, 2): [1, 5], (1, 6, 1): [6], (2, 1, 1): [1], (3, 37, 1): list(range(1, 38))}
    assert all([d for d, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in found.values())


def test_conversations_come_back(spark, folder):
    found = {r["conv_id"]: r for r in QUERIES["op7_chat_format"](spark, folder).collect()}
    z = "<|im_end|><|im_start|>assistant ok"
    assert found[-1]["turns_sha256"] == hashlib.sha256(f"user\n{z}\nassistant\n{z}\n".encode()).hexdigest()
    assert found[-1]["loss_sha256"] == hashlib.sha256(z.encode()).hexdigest()
    assert found[None]["turns_sha256"] == hashlib.sha256("u\ns~er\né<\n".encode()).hexdigest()
    assert found[1]["n_turns"] == 3 and found[1]["loss_chars"] == 4


def test_mixing_draws_poisson_numbers(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.lit("x" * 9).alias("text"),
        F.when(F.col("id") < 14_000, "big").when(F.col("id") < 19_990, "small").when(F.col("id") < 19_999, None).otherwise("tiny").alias("source"),
        F.lit(1).alias("copy"),
    )
    rates = {r["source"]: r["rate"] for r in mixing.rates(docs, {"big": 0.5, "small": 0.4, "tiny": 0.1}).collect()}
    assert rates == {"big": 0.714286, "small": 1.335559, None: 0.0, "tiny": 2000.0}
    found = mixing.copies(docs, {"big": 0.5, "small": 0.4, "tiny": 0.1})
    n = {r["source"]: r["count"] for r in found.groupBy("source").count().collect()}
    assert abs(n["big"] / 10_000 - 1) < 0.05 and abs(n["small"] / 8_000 - 1) < 0.05 and abs(n["tiny"] / 2_000 - 1) < 0.15
    counts = [r["n"] for r in found.where("source = 'big'").groupBy(F.col("_row.doc_id")).agg(F.count("*").alias("n")).collect()]
    drawn = np.bincount(counts, minlength=4)[1:4] / 14_000
    mean = rates["big"]
    assert np.allclose(drawn, np.exp(-mean) * mean ** np.arange(1, 4) / np.array([1, 2, 6]), atol=0.015)
    assert mixing.mixed(docs).columns == docs.columns
    assert rows_of(mixing.mixed(docs)) == rows_of(mixing.mixed(docs))


def jump_slowly(key, shards):
    state, at, goes = key, -1, 0
    while goes < shards:
        at = goes
        state = (state * sharding.MULTIPLIER + 1) % 2**64
        goes = int((at + 1) * (2.0**31 / ((state >> 33) + 1)))
    return at


def test_sharding(spark, docs):
    found = sharding.sharded(docs, 5, text_crc32=F.crc32(F.coalesce("text", F.lit("")))).collect()
    for r in found:
        key = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16)
        assert r["shard"] == jump_slowly(key, 5) and r["grown_shard"] == jump_slowly(key, 6)
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (r[0], size(r[1]), crc((r[1] or "").encode())) for r in ROWS
    )
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_files_hold_every_row(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).drop("_shard")) == rows_of(docs)


def test_language(spark):
    letters = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr"}
    rng = np.random.default_rng(0)
    text = lambda lang: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(20))
    rows = [(i, text(lang), lang) for i in range(240) for lang in [list(letters)[i % 3]]]
    rows += [(900, None, "aa"), (901, "12 !?", "aa"), (902, text("bb"), None), (903, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.col("doc_id") % 5 != 0)
    assert 0 < (model.weights == 0).mean() < 1  # sparse
    found = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows[:240])
    assert [found[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "bb", "und"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    none = langid.train(docs.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 4])
    good, ties = rng.normal(size=8), rng.normal(size=(2, 2))
    marginal, used = line_crf.forward_backward(good, ties, line_crf._steps(sizes))
    at, pairs = 0, np.zeros((2, 2))
    for n in sizes:
        total, ones = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(good[at + i] * y[i] for i in range(n)) + sum(ties[a, b] for a, b in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
        assert np.allclose(marginal[at : at + n], ones / total)
        at += n
    assert np.isclose(used.sum(), (sizes - 1).sum())


def test_quality_classifier(spark, docs):
    rows, labels = [], []
    for i in range(200):
        good = i % 3 > 0
        body = "\n".join(words(12, 1000 * i + k).capitalize() + "." for k in range(4))
        rows.append((i, body if good else body.upper().replace(" ", "!! ") + "\n### $$$ ***"))
        labels.append((i, int(good)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    field = line_crf.train(table, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("doc_id") % 4 != 2)
    scored = {r["doc_id"]: r["score"] for r in line_crf.score(table, field).collect()}
    right = [(scored[i] >= 0.7) == bool(q) for i, q in labels if i % 4 == 2]
    assert np.mean(right) > 0.95
    found = line_crf.score(docs.select("doc_id", "text"), field).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found)
    none = line_crf.train(table, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r["score"] for r in line_crf.score(table, none).collect()} == {0.5}
