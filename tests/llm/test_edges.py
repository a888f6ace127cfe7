"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from svloom.llm import chat, decontamination, line_dedup, quality, sharding, simhash, substring_dedup, token_counts, token_files, tokenizing
from svloom.llm.common import shared_dir
from svloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, shard string, n string, pos string, gone string, ids string, spans string, fingerprint string, component_id string, kept string, anchor string, b string, prefix string"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty once more"


def odd(spark):
    rows = [
        (1, WORDS, "en"), (1, WORDS, "en"), (1, "another " + WORDS, None), (2, None, "en"), (3, "", None), (None, WORDS, "en"), (None, None, None), (4, "\n \t\n", ""),
        (5, "x" * 20_000 + " " + WORDS * 40, "fr"), (6, WORDS.upper(), "de"), (7, "é\x1c\x85 \u2003 " + WORDS, "de"), (8, "a", "en"), (9, WORDS + "\n" + WORDS, "en"),
    ]
    return spark.createDataFrame([(*r, "s", 0, *["clash"] * 14) for r in rows], SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bench(spark):
    return spark.createDataFrame([(1, WORDS), (2, None), (3, ""), (None, "twenty once more")], "item_id long, text string")


def run_all(spark, docs):
    n = docs.count()
    out = {}
    out["shard"] = sharding.shard(docs, 3)
    rows = quality.measured(docs, quality.build_model(docs))
    out["quality"] = quality.judged(rows, quality.bands(rows))
    out["simhash"] = simhash.near_duplicates(docs)
    out["lines"] = line_dedup.dedup(docs)
    out["substrings"] = substring_dedup.digests(docs)
    out["bpe"] = tokenizing.encode_digests(docs, tokenizer("byte_bpe_50k.json"))
    out["ids"] = tokenizing.encode_decode(docs, tokenizer("byte_bpe_50k.json"))
    out["counts"] = token_counts.count_tokens(docs, tokenizer("word_bpe_49k.json"), shared_dir(spark, "cache"))
    root = shared_dir(spark, "ids")
    out["files"] = token_files.read_digests(spark, root, token_files.write_ids(docs, tokenizer("word_bpe_49k.json"), 1, root))
    got = {k: v.collect() for k, v in out.items()}
    assert {k: len(v) for k, v in got.items()} == dict.fromkeys(got, n)
    return got


def test_odd_rows(spark):
    got = run_all(spark, odd(spark))
    by = lambda k, i: [r for r in got[k] if r["doc_id"] == i]
    assert sorted((r["shard"], r["slot"]) for r in got["shard"]) == sorted((i % 3, i // 3) for i in range(13))
    assert all(r["component_id"] == 1 for r in by("simhash", 1)[:2])
    assert {r["component_id"] for r in got["simhash"] if r["fingerprint"] == 0} == {2}
    assert by("lines", 2)[0]["text"] is None
    assert by("lines", 4)[0]["text"] == "\n \t\n"
    assert by("lines", 9)[0]["text"] == ""
    assert by("substrings", 2)[0]["n_bytes"] == 0
    assert by("counts", 3)[0]["n_tokens"] == 0
    assert by("files", 3)[0]["n_tokens"] == 1
    assert all(r["n_tokens"] == 0 for r in by("bpe", 2))


def test_empty_tables(spark):
    run_all(spark, none(spark))
    assert decontamination.leaks(none(spark), bench(spark)).count() == 0
    assert decontamination.leaks(odd(spark), bench(spark).limit(0)).count() == 0
    assert chat.conversation_digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_odd_leaks(spark):
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(odd(spark), bench(spark)).collect()}
    assert found == {(i, 1) for i in (1, None, 5, 6, 7, 9)}


def test_odd_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, None, "user", "x"), (2, 1, "assistant", ""), (2, 1, "assistant", "y")]
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (2, 0), None: (1, 0), 2: (2, 1)}


@pytest.mark.parametrize("make", [odd, none])
def test_stages(spark, make, tmp_path):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make(spark)
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/stage{i}"
        out.write.parquet(path)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        docs = spark.read.parquet(path)
        if make is odd and i == 0:
            assert docs.where(F.col("doc_id") == 1).count() == 3


def test_run_is_its_stages_in_order(spark, tmp_path):
    from svloom.llm.common import saved

    rows = [(i, f"{WORDS} number {i} " + " ".join(f"w{(i * 7 + k) % 97}" for k in range(60)), "en", "s", 0) for i in range(30)]
    spark.createDataFrame(rows + [(40, rows[3][1], "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of the kind is in these rows at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(corpus_pipeline.run(spark, str(tmp_path)).collect()) == key(docs.collect())
    assert 40 not in {r["doc_id"] for r in docs.collect()}
