"""The training-data operators against brute force on small tables."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from svloom.llm import chat, decontamination, line_dedup, quality, sharding, simhash, substring_dedup, suffix_array, token_counts, token_files, tokenizing
from svloom.llm.common import P, shared_dir
from svloom.llm.queries import tokenizer


def corpus(n=80, seed=3):
    """Texts with words of two languages, copies, near copies, repeated lines and a very long one."""
    rng = random.Random(seed)
    syllables = {"en": "the an ing ed re tion of and st er".split(), "fr": "le é ment eux oi çe au un que ai".split()}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3)))
    line = lambda lang: " ".join(word(lang) for _ in range(rng.randint(1, 30))) + "."
    shared = [line("en") for _ in range(4)]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        k = rng.random()
        if k < 0.1 and rows:
            text = rng.choice(rows)[1]
        elif k < 0.25 and rows:
            words = rng.choice(rows)[1].split(" ")
            words[rng.randrange(len(words))] = word(lang)
            text = " ".join(words)
        else:
            text = "\n".join(rng.choice(shared) if rng.random() < 0.2 else line(lang) for _ in range(rng.randint(0, 12)))
        rows.append((i, text, lang))
    rows[5] = (5, " ".join(word("en") for _ in range(9000)), "en")
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


# Sharding


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 7)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(p, n, 7, back=True) == np.arange(n)).all()


def test_shards(spark):
    rows = sharding.shard(frame(spark, corpus()), 7, ties=("text",)).toPandas()
    by = rows.groupby("shard")
    assert by.size().max() - by.size().min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in by)
    assert (rows.sort_values("doc_id")["row"].to_numpy() == np.arange(len(rows))).all()
    for r in rows.head(10).itertuples():
        assert sharding.row_of(r.shard, r.slot, 7, len(rows)) == r.row


def test_hot_keys_are_numbered_in_many_tasks(spark):
    docs = spark.createDataFrame([(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i % 500}") for i in range(3000)], "doc_id long, text string").repartition(6)
    numbered, n = sharding.numbered(docs, "doc_id", ["text"], "row")
    assert n == 3000
    rows = sorted(numbered.collect(), key=lambda r: r["row"])
    assert [r["row"] for r in rows] == list(range(3000))
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))
    texts = [r["text"] for r in rows if r["doc_id"] == 7]
    assert sum(a != b for a, b in zip(texts, texts[1:], strict=False)) == len(set(texts)) - 1  # equal ones stay together
    assert len(rows) == len({tuple(r) for r in rows})


# Quality


def brute_scores(rows):
    """Modified Kneser-Ney by dictionaries."""
    grams = defaultdict(Counter)
    code = lambda c: [max(ord(c), 1)] if ord(c) < 2048 else [2048 + (ord(c) >> 11), ord(c) & 2047]

    def of(word):
        s = [2] * 4 + [x for c in word for x in code(c)] + [3]
        return [tuple(s[i : i + 5]) for i in range(len(s) - 4)]

    for _, text, lang in rows:
        for w in text.split():
            grams[lang].update(of(w))
    p = {}
    for lang, top in grams.items():
        levels = {5: top}
        for k in (4, 3, 2, 1):
            levels[k] = Counter()
            for g, v in levels[k + 1].items():
                levels[k][g[1:]] += v if g[1] == 2 else 1
        below = None
        for k in range(1, 6):
            c = levels[k]
            n = Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            cut = {i: max(0.0, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[1] else 0.5 for i in (1, 2, 3)}
            total, rest = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                rest[g[:-1]] += cut[min(v, 3)]
            below = {g: (v - cut[min(v, 3)]) / total[g[:-1]] + rest[g[:-1]] / total[g[:-1]] * (below[g[1:]] if below else 1 / 4096) for g, v in c.items()}
        p[lang] = below
    out = {}
    for i, text, lang in rows:
        x = [math.log(p[lang][g]) for w in text.split() for g in of(w)]
        out[i] = -sum(x) / len(x) if x else None
    return out


def test_perplexity(spark):
    rows = corpus(40)
    docs = frame(spark, rows)
    got = {r["doc_id"]: r[P + "log_perplexity"] for r in quality.measured(docs, quality.build_model(docs)).collect()}
    expected = brute_scores(rows)
    assert got.keys() == expected.keys()
    for i, x in expected.items():
        assert (got[i] is None) == (x is None)
        assert x is None or got[i] == pytest.approx(x, rel=1e-5)


def test_base_rules():
    words = lambda s: np.array([hash(w) % 1000 for w in s.split()], dtype=np.int32)
    a = "a b c d e f g h"
    assert quality.repeat_words(words(a)) == 0
    assert quality.repeat_words(words(f"{a} x {a}")) == 16
    assert quality.repeat_words(words("z " * 9)) == 9
    assert quality.repeat_words(words("z " * 8)) == 0
    assert quality.dup_lines("a\n\n\n a\na\nb\na") == 2


def test_band_rejects_planted_junk(spark):
    rng = random.Random(11)
    lexicon = ["".join(rng.choice("the an ing ed re tion of and st er".split()) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    text = lambda n: [rng.choice(lexicon) for _ in range(n)]
    clean = {i: " ".join(text(rng.randint(60, 900))) for i in range(400)}
    junk = {1000 + i: " ".join(w + rng.choice(["***", "%%%", "$$$", "&&&"]) for w in text(rng.randint(60, 900))) for i in range(20)}
    junk |= {2000 + i: " | ".join(text(rng.randint(60, 900))) for i in range(20)}
    docs = frame(spark, [(i, t, "en") for i, t in (clean | junk).items()])
    rows = quality.measured(docs, quality.build_model(docs))
    kept = {r["doc_id"] for r in quality.judged(rows, quality.bands(rows)).where(f"{P}kept").collect()}
    assert not kept & junk.keys()
    assert len(kept) >= 0.95 * len(clean)


# Decontamination


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 15))]) for _ in range(2))
        score, same, stretch, begin, end = decontamination.align(a, b)
        assert score == brute_align(a, b)
        assert stretch <= same
        assert begin <= end


def test_longest_stretch():
    rng = random.Random(5)
    for _ in range(500):
        steps = [rng.random() < rng.choice([0.5, 0.8, 0.95]) for _ in range(rng.randint(0, 40))]
        best = max((sum(steps[i:j]) for i in range(len(steps)) for j in range(i + 1, len(steps) + 1) if 5 * sum(steps[i:j]) >= 4 * (j - i)), default=0)
        assert decontamination.longest_stretch(steps) == best


def test_exact_stretch_within_a_poor_alignment(spark):
    words = [f"w{i}" for i in range(200)]
    text = " ".join([*words[:30], *[f"x{i}" for i in range(40)], *words[70:95]])
    found = decontamination.leaks(spark.createDataFrame([(1, text), (2, " ".join(words[:10]))], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"))
    assert [r["doc_id"] for r in found.collect()] == [1]


def test_short_items_match_lines(spark):
    docs = spark.createDataFrame([(1, "so\nWhat is it?\nend"), (2, "and what is it then"), (3, None), (4, "what is it")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "What is it?"), (8, ""), (9, "!!")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["begin"], r["end"]) for r in decontamination.leaks(docs, items).collect()) == [(1, 7, 1, 4), (4, 7, 0, 3)]


def test_leaks(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(30)) for i in range(6)] + [(6, "two words"), (7, None), (8, "")]
    docs = [(i, text(120)) for i in range(30)]
    planted = {}
    for i in range(0, 24, 2):  # exact, then with substituted, dropped and added words
        words = items[i % 6][1].split()
        for _ in range({0: 0, 1: 5, 2: 3}[i // 8]):
            j = rng.randrange(len(words))
            words[j : j + 1] = rng.choice([["new"], [], [words[j], "more"]])
        docs[i] = (i, f"{text(40)} {' '.join(words)} {text(40)}")
        planted[i] = i % 6
    docs += [(100 + i, f"{text(10)} {items[0][1].upper()} {text(10)}") for i in range(20)]  # a frequent leak
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {*planted.items(), *((100 + i, 0) for i in range(20))}
    kept = decontamination.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - planted.keys() - {100 + i for i in range(20)}


# SimHash


def brute_fingerprint(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(marks):
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(marks)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    rows = corpus(120)
    got = {r["doc_id"]: (r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    marks = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert {i: f for i, (f, _) in got.items()} == marks
    assert {i: c for i, (_, c) in got.items()} == brute_components(marks)


def test_linked_sets_of_any_size(spark, monkeypatch):
    """Chains and clouds of close fingerprints, split by their varying bits as well."""
    monkeypatch.setattr(simhash, "DIRECT", 8)
    rng = random.Random(6)
    marks, now = {}, rng.getrandbits(64)
    for i in range(300):
        now = now ^ (1 << rng.randrange(64)) if i % 60 else rng.getrandbits(64)
        marks[i] = now
    x = np.array(list(marks.values()), dtype=np.uint64)
    root = np.arange(len(x))
    simhash._merge(x, root, np.arange(len(x)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    groups = lambda f: {frozenset(k for k in marks if f(k) == v) for v in {f(k) for k in marks}}
    expected = brute_components(marks)
    assert groups(top) == groups(expected.get)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(marks.values())], "fingerprint long")
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.linked_pairs(nodes)).collect()}
    assert groups(lambda k: roots.get(marks[k], marks[k])) == groups(expected.get)


def test_keep_first(spark):
    rows = corpus(60)
    kept = {r["doc_id"] for r in simhash.keep_first(frame(spark, rows)).collect()}
    assert kept == set(brute_components({i: brute_fingerprint(t) for i, t, _ in rows}).values())


def test_keep_first_goes_by_group_not_by_doc_id(spark):
    """Null and repeated ids with different texts stay; copies among them go."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1), "en"), (None, text(2), "en"), (None, text(3), "en"), (7, text(4), "en"), (7, text(5), "en"), (8, text(5), "en"), (None, text(4), "en"), (None, text(3), "en"), (9, text(6), "en")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_first(frame(spark, rows)).collect())
    assert got == sorted([(0, text(1)), (0, text(2)), (0, text(3)), (7, text(4)), (7, text(5)), (9, text(6))])


# Line dedup


def brute_lines(rows):
    seen, out = [], {}
    for i, text, _ in sorted(rows):
        kept = []
        for line in text.split("\n"):
            words = frozenset(line.encode().split())
            similar = words and any(100 * len(words & s) >= 80 * len(words | s) for s in seen)
            if words:
                seen.append(words)
            if not similar:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup(spark):
    rows = corpus(70)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_joins_what_the_first_lines_do_not_settle(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(20)]
    rows = []
    for i in range(60):  # a cloud in which similarity isn't transitive
        words = base[:]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(20)] = f"x{rng.randint(0, 30)}"
        rows.append((i, " ".join(words), "en"))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_at_the_limits_of_length(spark):
    rows = []
    for n in range(1, 90):  # supersets of five quarters, and one word more; the longer line first or last
        for k, m in enumerate((n * 5 // 4, n * 5 // 4 + 1)):
            short, long = (" ".join(f"n{n}k{k}w{i}" for i in range(s)) for s in (n, m))
            rows += [(4 * n + 2 * k, (short, long)[n % 2], "en"), (4 * n + 2 * k + 1, (long, short)[n % 2], "en")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_lines_of_far_lengths_do_not_meet(spark):
    sizes = (10, 12, 40)
    rows = [(n, 0, n, list(range(n - (n * 80 + 99) // 100 + 1))) for n in sizes]
    posted = line_dedup.postings(spark.createDataFrame(rows, "doc_id long, pos int, n int, prefix array<long>")).collect()
    met = {n: {r["meet"] for r in posted if r["doc_id"] == n} for n in sizes}
    assert met[10] & met[12] and not (met[10] | met[12]) & met[40]
    assert {r["i"] for r in posted if r["doc_id"] == 40 and not r["guest"]} == set(range(9))


def test_line_dedup_sketches_of_the_rarest_keys_lose_no_pair(spark):
    long = spark.range(1).select(F.expr("sequence(1L, 301L)").alias("keys"), F.lit(301).alias("n"))
    bits = long.select((F.bit_count(line_dedup._parity(0)) + F.bit_count(line_dedup._parity(1))).alias("bits")).first()["bits"]
    assert bits % 2 == 0  # 150 of the 301 keys
    rng = random.Random(5)
    rows = []
    for n in (50, 60, 63, 64, 70, 80, 100, 130, 160, 260):  # pairs that are just similar, or just not
        for m in {n, n * 9 // 8, n * 5 // 4}:
            for less in (0, 1):
                shared = -(-80 * (n + m) // 180) - less
                words = [f"n{n}m{m}l{less}w{i}" for i in range(n + m - shared)]
                common = words[:shared]
                rng.shuffle(common)
                odd = rng.sample(words[shared:], 5)
                lines = [" ".join(common + words[shared:n]), " ".join(common + words[n:]), " ".join(odd), " ".join(odd[:2])]
                rows += [(len(rows) + i, t, "en") for i, t in enumerate(lines)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)


# Suffix arrays


@pytest.mark.parametrize("held", [1 << 20, 40])
def test_suffix_order(held, monkeypatch):
    monkeypatch.setattr(suffix_array.TupleQueue.__init__, "__defaults__", (held,))
    monkeypatch.setattr(suffix_array, "HELD", held)
    monkeypatch.setattr(suffix_array, "MAPPED", held)
    monkeypatch.setattr(suffix_array, "READ", 7)
    monkeypatch.setattr(suffix_array, "CHUNK", 13)
    rng = random.Random(0)
    for k in range(60):
        s = [rng.randint(1, rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(1, 200))] * rng.randint(1, 3)
        cap = rng.choice([3, 100, 254])
        blocks = list(suffix_array.sorted_suffixes(np.array(s), cap))
        at = np.concatenate([a for a, _ in blocks]).tolist()
        assert at == sorted(range(len(s)), key=lambda i: s[i:], reverse=True)
        lcp = np.concatenate([c for _, c in blocks]).tolist()
        agree = lambda x, y: min(cap, next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))))
        assert lcp == [0, *(agree(s[a:], s[b:]) for a, b in zip(at, at[1:], strict=False))]


def test_suffixes_of_a_text_beyond_memory(monkeypatch):
    """A text a hundred times as long as what queues and arrays hold."""
    for name, value in (("HELD", 2000), ("MAPPED", 2000), ("READ", 500), ("CHUNK", 1500)):
        monkeypatch.setattr(suffix_array, name, value)
    monkeypatch.setattr(suffix_array.TupleQueue.__init__, "__defaults__", (2000,))
    spilled = []
    monkeypatch.setattr(suffix_array.Buckets, "_spill", lambda self, was=suffix_array.Buckets._spill: (spilled.append(self.size), was(self)))
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    data = "".join(rng.choice(words) for _ in range(6500)).encode()[:200_000]
    blocks = list(suffix_array.sorted_suffixes(np.frombuffer(data, np.uint8) + np.uint16(1), 100))
    at, lcp = (np.concatenate(x) for x in zip(*blocks, strict=True))
    assert sorted(at) == list(range(len(data)))
    assert len(spilled) > 50
    for k in rng.sample(range(1, len(at)), 3000):
        a, b = data[at[k] : at[k] + 100], data[at[k - 1] : at[k - 1] + 100]
        assert data[at[k] :] < data[at[k - 1] :]
        assert lcp[k] == len(os.path.commonprefix([a, b]))


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows):
        data = text.encode()
        mark = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                mark[k : k + 100] = b"\x01" * 100
            seen.add(data[k : k + 100])
        kept = bytes(x for x, m in zip(data, mark, strict=True) if not m)
        out[i] = (len(data), sum(mark), sum(mark[k] and not (k and mark[k - 1]) for k in range(len(data))), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(spark):
    rng = random.Random(5)
    rows = corpus(40)
    for i in range(100, 140):
        parts = [rng.choice(["a", "ab", "abc", "xyzw "]) * rng.randint(10, 200) if rng.random() < 0.4 else rng.choice(rows)[1][: rng.randint(50, 400)] for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts), "en"))
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.digests(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_contexts_that_share_only_an_anchor_are_not_sorted(monkeypatch):
    """Phrases shorter than a string make anchors of many contexts; only those that may share a string go on, however rows are batched."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).encode()
    phrase, passages = noise(50), [noise(100) for _ in range(9)]
    apart = [noise(150) + phrase + noise(150) for _ in range(60)]
    alike = [noise(rng.randint(0, 150)) + passages[i % 9] + noise(rng.randint(0, 150)) for i in range(60)]

    def asked(texts, rows):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["row", "text"])
        table = pa.Table.from_batches(substring_dedup._run_rows(iter([batch]))).sort_by([(c, "ascending") for c in ("anchor", "digest", "check", "row", "start")])
        out = pa.Table.from_batches(substring_dedup._classes(iter(table.to_batches(max_chunksize=rows))))
        anchors = table["anchor"].to_pylist()
        assert len(set(anchors)) < len(anchors)
        return sorted(tuple(r.values()) for r in out.to_pylist())

    assert asked(apart, 5000) == []
    found = asked(apart + alike, 5000)
    assert found and {r[1] for r in found} == set(range(60, 120))
    # Each document's whole passage is in a context of its own that goes on, or in a later run of one.
    where = {(r[1], i) for r in found for i in range(r[2], r[2] + r[3])}
    assert all((60 + i, t.index(passages[i % 9])) in where for i, t in enumerate(alike))
    assert asked(apart + alike, 7) == asked(apart + alike, 1) == found
    monkeypatch.setattr(substring_dedup, "COMPARED", 3)
    assert set(asked(apart + alike, 7)) >= set(found)


def test_hot_anchors_are_split(spark, monkeypatch):
    """One passage with other text around it in every document."""
    monkeypatch.setattr(substring_dedup, "HOT", 5)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [noise(140), noise(101), noise(100), noise(60)]
    rows = [(i, noise(rng.randint(0, 150)) + rng.choice(passages)[rng.choice([0, 0, 3]) :] + noise(rng.randint(0, 150)) + "ab" * rng.choice([0, 90]), "en") for i in range(80)]
    split = []
    monkeypatch.setattr(substring_dedup, "_split", lambda *a, was=substring_dedup._split: split.append(a) or was(*a))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([rows[0][1].encode()]), pa.array([[]], pa.list_(pa.struct([("anchor", pa.int64()), ("start", pa.int32()), ("n", pa.int16()), ("hot", pa.bool_())])))], names=["row", "text", "runs"])
    assert not list(substring_dedup._contexts(iter([batch])))
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.digests(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_a_shard_beyond_memory(monkeypatch):
    """Contexts of one deal that go to files."""
    rng = random.Random(8)
    shared = ["".join(rng.choice("abcd") for _ in range(150)).encode() for _ in range(9)]
    rows = []
    for k in range(600):
        c = rng.choice(shared)[rng.randint(0, 20) :]
        rows.append((5, k, rng.randint(0, 50), len(c) - 99, c))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary()), strict=True)], names=["deal", "row", "start", "n", "context"])
    unite = lambda: {(r["row"], i) for b in substring_dedup._shards(iter([batch.slice(i, 50) for i in range(0, 600, 50)])) for r in b.to_pylist() for i in range(r["start"], r["end"])}
    whole = unite()
    for name, value in (("HELD", 500), ("MAPPED", 500), ("READ", 100), ("CHUNK", 400)):
        monkeypatch.setattr(suffix_array, name, value)
    monkeypatch.setattr(substring_dedup, "SHARD", 2000)
    assert unite() == whole
    first, expected = {}, set()
    for _, row, start, n, c in sorted(rows, key=lambda r: (r[1], r[2])):
        for i in range(n):
            if first.setdefault(c[i : i + 100], (row, start + i)) != (row, start + i):
                expected |= {(row, start + i + j) for j in range(100)}
    assert whole == expected


def test_shards_of_suffixes_are_cut_between_anchors(spark, monkeypatch):
    rng = random.Random(1)
    contexts = [("".join(rng.choice("ab") for _ in range(130))).encode() for _ in range(30)]
    rows = [(k // 3, k, 0, 31, contexts[k // 2]) for k in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary()), strict=True)], names=["deal", "row", "start", "n", "context"])
    spans = lambda parts: sorted(tuple(r.values()) for b in substring_dedup._shards(iter(parts)) for r in b.to_pylist())
    whole = spans([batch])
    monkeypatch.setattr(substring_dedup, "SHARD", 300)
    pieces = spans([batch.slice(i, 4) for i in range(0, 30, 4)])
    # Contexts here recur under different anchors, which real ones can't; within an anchor the results agree.
    assert set(pieces) <= set(whole)
    assert {r for r in pieces} == {(k, 0, 130) for k in range(30) if any(rows[j][0] == rows[k][0] and contexts[j // 2] == contexts[k // 2] for j in range(k))}


# Tokenizers


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("word_bpe_49k.json"))


def test_tree_encoding(byte_bpe):
    rng = random.Random(1)
    enc = tokenizing.TreeEncoder(tokenizer("byte_bpe_50k.json"), long_text=50, leaf=20, window=2)
    parts = ["the", "ing", "é", "x", "1", "$", " ", "  ", "\n", "<|endoftext|>", "中", "'s", "ation", "===", "\t", "\U0001f600"]
    for _ in range(400):
        t = "".join(rng.choice(parts) * rng.choice([1, 1, 30]) for _ in range(rng.randint(0, 30))) + "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(0, 300)))
        ids = enc.encode_all([t])[0]
        assert ids == byte_bpe.encode(t, add_special_tokens=False).ids
        assert enc.decode(ids).decode() == byte_bpe.decode(ids, skip_special_tokens=False) == t
    assert enc.joins > 1000


def test_latin_texts(byte_bpe):
    rng = random.Random(12)
    enc = tokenizing.TreeEncoder(tokenizer("byte_bpe_50k.json"))
    parts = [*map(chr, range(256)), "'s", "'ll", " the", "ation", "  ", "12", "\xa0\xa0", "<|endoftext|>", "\u2003", "Ā", "'S"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(6000)] + [f"a{c}{c} {c}b1{c}" for c in map(chr, range(256))]
    assert enc.encode_all(texts) == [byte_bpe.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_are_trees(byte_bpe):
    rng = random.Random(7)
    enc = tokenizing.TreeEncoder(tokenizer("byte_bpe_50k.json"))
    words = ["the", "ation", "don't", "x1", "!'s", "'ll", "é", "中文", "\u2003", "\x1c", "\u00a0y", "12", "_", "...", "\n", "\t\t", "  ", "a\u0301"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (10, 900, 3000, 20_000, 40_000)] + ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(9000))]
    texts += [texts[2] + "<|endoftext|>" + texts[3], "x" * 5000 + texts[2], " " * 5000 + texts[2]]
    assert enc.encode_all(texts) == [byte_bpe.encode(t, add_special_tokens=False).ids for t in texts]
    assert enc.joins >= sum(len(t) // tokenizing.LEAF for t in texts if len(t) > tokenizing.LONG_TEXT) / 2


def test_very_long_unsplit_text(byte_bpe):
    t = "".join(random.Random(2).choice("abcdefgh") for _ in range(30_000))
    assert tokenizing.TreeEncoder(tokenizer("byte_bpe_50k.json")).encode_all([t, "", "x"])[0] == byte_bpe.encode(t, add_special_tokens=False).ids


def test_word_encoding(word_bpe):
    enc = tokenizing.ChunkEncoder(tokenizer("word_bpe_49k.json"))
    rng = random.Random(3)
    wide = [chr(c) for c in range(256)] + ["<|endoftext|>", "'s", "'LL", "Σ", "œ", "中", "İ", "a\u0301", "\ufb01", "\u2003", " ", "e", "The", "don't"]
    narrow = [chr(c) for c in range(256)]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 30))) for a in (wide, narrow) for _ in range(1500)] + [f"a{c}1{c}" for c in narrow]
    for t, ids in zip(texts, enc.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == word_bpe.encode(t, add_special_tokens=False).ids, repr(t)


def test_encode_digests(spark, byte_bpe):
    rows = corpus(30)
    for r in tokenizing.encode_digests(frame(spark, rows), tokenizer("byte_bpe_50k.json")).collect():
        ids = byte_bpe.encode(rows[r["doc_id"]][1], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]][1].encode()).hexdigest()


def test_token_counts_and_cache(spark, word_bpe):
    rows = corpus(30)
    cache = shared_dir(spark, "cache")
    count = lambda r: {x["doc_id"]: (x["n_bytes"], x["n_tokens"]) for x in token_counts.count_tokens(frame(spark, r), tokenizer("word_bpe_49k.json"), cache).collect()}
    expected = {i: (len(t.encode()), len(word_bpe.encode(t, add_special_tokens=False).ids)) for i, t, _ in rows}
    assert count(rows[:20]) == {i: expected[i] for i in range(20)}
    before = spark.read.parquet(cache).count()
    assert before == len({token_counts.normalise(t) for _, t, _ in rows[:20]})
    assert count(rows) == expected
    assert spark.read.parquet(cache).count() == len({token_counts.normalise(t) for _, t, _ in rows})
    assert count(rows) == expected
    assert spark.read.parquet(cache).count() == len({token_counts.normalise(t) for _, t, _ in rows})


def test_file_format():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ids = (rng.zipf(1.3, n) % 70_000).astype(np.uint32)
        docs, ids2, back = np.array([3, 9]), np.array([n // 2, n - n // 2]), None
        d, c, back, nulls, before = token_files.unpack(token_files.pack(docs, ids2, ids, 1, 7))
        assert (nulls, before) == (1, 7)
        assert d.tolist() == [3, 9]
        assert c.tolist() == ids2.tolist()
        assert back.tolist() == ids.tolist()
    with pytest.raises(ValueError, match="not a token-id file"):
        token_files.unpack(b"x" * 100)


def test_null_ids_come_back(spark, word_bpe):
    low = -(1 << 63)
    docs = spark.createDataFrame([(None, "a b"), (low, "c"), (None, None), (5, "d")], "doc_id long, text string")
    root = shared_dir(spark, "ids")
    path = tokenizer("word_bpe_49k.json")
    for _ in range(2):  # a second run finds the files of the first
        got = token_files.read_digests(spark, root, token_files.write_ids(docs, path, 1, root)).collect()
        assert {r["start"]: (r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] is not None} == {4: (low, 2), 6: (5, 2)}
        assert sorted(r["n_tokens"] for r in got if r["doc_id"] is None) == [1, 3]
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in token_files.read_ids(spark, root).collect()) == [(low, 2), (0, 1), (0, 3), (5, 2)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    path = tokenizer(name)
    rows = [(i, t) for i, t in enumerate([" two  spaces\r\n", "two  spaces", "Upper <s> x", "", "é中\t"])]
    if name.endswith("json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    else:
        import sentencepiece

        ids = sentencepiece.SentencePieceProcessor(model_file=path).encode
    assert not tokenizing.drops_space(path)
    docs, root = spark.createDataFrame(rows, "doc_id long, text string"), shared_dir(spark, "ids")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path, shared_dir(spark, "cache")).collect()} == {i: len(ids(t)) for i, t in rows}
    token_files.write_ids(docs, path, 2, root)
    assert {r["doc_id"]: r["ids"] for r in token_files.read_ids(spark, root).collect()} == {i: [*ids(t), 2] for i, t in rows}


def test_token_files(spark, word_bpe):
    rows = corpus(40)
    root = shared_dir(spark, "ids")
    parts = token_files.write_ids(frame(spark, rows), tokenizer("word_bpe_49k.json"), 1, root, file_ids=500)
    assert token_files.read_ids(spark, root).select("file").distinct().count() > len(parts)
    got = {r["doc_id"]: r for r in token_files.read_digests(spark, root, parts).collect()}
    back = {r["doc_id"]: r["ids"] for r in token_files.read_ids(spark, root).collect()}
    start = 0
    for i, t, _ in rows:
        ids = [*word_bpe.encode(t, add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert back[i] == ids
        start += len(ids)


# Chat


@pytest.mark.parametrize("text", ["", "\n", "a\n</turn>\n", r"\### Assistant: </turn> ok", "\\", "</turn>", "\n</turn>", "\\\\</turn>\n### x:\n", "### user:\nhi\n</turn>\n", "x\n", "</turn>\n"])
@pytest.mark.parametrize("role", ["user", "assistant", "", "a:\nb", "### é%"])
def test_chat_round_trip(text, role):
    out = chat.render(role, text)
    assert chat.turns(out * 2) == [(role, text)] * 2


def test_chat_random():
    rng = random.Random(7)
    for _ in range(2000):
        t = "".join(rng.choice(["#", "##", "###", "\\", "</turn>", "\n", "/turn>", "<", "a", ":", "é"]) for _ in range(rng.randint(0, 12)))
        assert chat.turns(chat.render("user", t)) == [("user", t)]


def test_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} ### {t}" * (t % 3)) for c in range(5) for t in range(c + 1)]
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))).collect()}
    for c in range(5):
        own = [r for r in rows if r[0] == c]
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        said = "".join(t for _, _, r, t in own if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(chat.render(r, t)) for _, _, r, t in own)
