"""The registered training-data queries against brute force, over the smallest tables."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from oracle import DATA
from test_operators import brute_scores

from svloom.llm import decontamination, quality, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def docs():
    found = duckdb.sql(f"SELECT doc_id, text, lang FROM read_parquet('{DATA}/documents.parquet') ORDER BY doc_id").fetchall()
    return [(i, t or "", lang) for i, t, lang in found]


def run(spark, name):
    return {r["doc_id"]: r.asDict() for r in queries.queries()[name](spark, DATA).collect()}


def test_sharding(spark, docs):
    got = run(spark, "op1_sharding")
    assert got.keys() == {i for i, _, _ in docs}
    by = defaultdict(list)
    for i, t, _ in docs:
        r = got[i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None)
        by[r["shard"]].append(r["slot"])
    assert by.keys() == set(range(queries.SHARDS))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def repeated(words):
    spots = defaultdict(list)
    for i in range(len(words) - 7):
        spots[tuple(words[i : i + 8])].append(i)
    return len({k for own in spots.values() if len(own) > 1 for i in own for k in range(i, i + 8)})


def middle(x):
    return sorted(x)[math.ceil(len(x) / 2) - 1]


def test_quality(spark, docs):
    got, scores = run(spark, "op2_quality"), brute_scores(docs)
    base, kept, reach = {}, {}, {}
    for i, t, lang in docs:
        words = t.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ")
        words = [w for w in words if w]
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        own = (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated(words))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == own
        base[i] = own[0] < 20 or 100 * own[4] > 30 * own[0]
        reach[i] = math.sqrt(1 + quality.SPREAD_CHARS / max(1, own[0] + own[1]))
    for lang in {x for _, _, x in docs}:
        passed = [i for i, _, x in docs if x == lang and not base[i]]
        if passed:
            m = middle([scores[i] for i in passed])
            d = max(quality.LEAST_SPREAD, middle([abs(scores[i] - m) / reach[i] for i in passed]))
            for i in passed:
                kept[i] = -quality.LOWER <= (scores[i] - m) / (d * reach[i]) <= quality.UPPER
    assert {i: r["base_failed"] for i, r in got.items()} == base
    assert {i: r["kept"] for i, r in got.items()} == {i: kept.get(i, False) for i in got}
    assert len({*kept.values()}) == 2


def test_decontamination(spark, docs):
    """Every pair is aligned, whole text against whole item."""
    items = duckdb.sql(f"SELECT item_id, text FROM read_parquet('{DATA}/benchmark.parquet')").fetchall()
    found = {(r["doc_id"], r["item_id"]) for r in queries.queries()["op3_decontamination"](spark, DATA).collect()}
    number = {}
    ids = lambda t: np.array([number.setdefault(w, len(number)) for w in decontamination.words(t)])
    known = [(k, ids(t)) for k, t in items]
    expected = set()
    for i, t, _ in docs:
        x = ids(t)
        for k, item in known:
            if len(np.intersect1d(x, item)) >= decontamination.MATCHED and decontamination.leaked(decontamination.align(item, x), len(item)):
                expected.add((i, k))
    assert expected
    assert found == expected


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in lower.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    got = run(spark, "op4_simhash")
    prints = {i: brute_fingerprint(t) for i, t, _ in docs}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{x:016x}", find(i)) for i, x in prints.items()}


def test_substring_dedup(spark, docs):
    got, seen = run(spark, "op6_substring_dedup"), set()
    for i, t, _ in docs:
        data = t.encode()
        gone = np.zeros(len(data) + 1, np.int8)
        for k in range(len(data) - 99):
            own = data[k : k + 100]
            if own in seen:
                gone[k : k + 100] = 1
            seen.add(own)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()))
        assert r["kept_sha256"] == hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=False) if not g)).hexdigest()


def test_encoding(spark, docs):
    from tokenizers import Tokenizer

    got, tok = run(spark, "op7_bpe"), Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    for i, t, _ in docs:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_counts_and_files(spark, docs):
    from tokenizers import Tokenizer

    counts, files, tok, start = run(spark, "op8_token_counts"), run(spark, "op10_token_files"), Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json")), 0
    for i, t, _ in docs:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert tuple(counts[i][c] for c in ("n_bytes", "n_tokens", "over_limit")) == (len(t.encode()), len(ids), len(ids) > 2048)
        own = np.array([*ids, 1], "<u4")
        assert tuple(files[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert Counter(len(r) for r in files.values()) == {4: len(docs)}
