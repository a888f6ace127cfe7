"""Quality rules: base counts and an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model over the characters of words: a word's
characters and its end are predicted from the four characters before (the word's start at
first), so a word's probability depends on the word and language alone. Spark counts the
n-grams of all documents, by blocks of text that are summed in their task first, and derives
continuation counts, discounts and probabilities of all orders by grouping and joining (n-grams
that begin a word keep their own counts, as nothing else can stand before them). The
model is kept as arrays of packed n-grams, sorted by language and n-gram, with log probabilities in the shared folder.
A worker holds the arrays of a model of HELD_GRAMS n-grams at most and looks n-grams up by binary search; of a larger
one it reads the row groups that may hold a block's n-grams, one after the other. So neither counts nor model pass
through the driver or have to fit a task's memory.

A character beyond 2047 is two symbols, so that n-grams are packed without loss; perplexities are by symbol.

The perplexity of a document is that of its words' characters. A mean over n characters scatters the
more the shorter the text, so a log-perplexity's distance from the language's median m is divided by
sqrt(1 + SPREAD_CHARS / n). By language, the median absolute deviation d of these distances, over the
documents that pass the base rules, gives the band: documents below m by more than LOWER * max(d, LEAST_SPREAD)
or above by more than UPPER * max(d, LEAST_SPREAD) are rejected. What lies far above are words with symbols
or of other languages, far below repetitive text. A null language is one of its own; so is an empty one.

SPREAD_CHARS, LOWER and UPPER were set on a bounded sample: the labelled rows of sf0.1 with an even doc_id that
pass the base rules. Of a grid, they reject most of what is labelled quality 0 at 2 % of quality 1; the rows with
an odd doc_id were kept for the test of that choice.

A null or empty text has no words and fails the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from svloom.llm.common import P, bounded_batches, shared_dir, trim

ORDER = 5
CHAR_BITS = 12
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
#: The band's reach below and above the median in median absolute deviations, and the least such deviation (nats a character, of an endless text).
LOWER, UPPER = 3.5, 3.5
LEAST_SPREAD = 0.002
#: A text of so many characters scatters by sqrt(2) of what an endless one does.
SPREAD_CHARS = 10_000
#: A block is ended by the batch that takes it over so many characters.
BLOCK_CHARS = 3 << 20
BEGIN, END = 2, 3
#: A character above PLAIN is a symbol of its high bits, then one of its low bits.
PLAIN, LOW_BITS = 2047, 11
#: N-grams of a model (12 bytes each) that a worker holds.
HELD_GRAMS = 4 << 20
#: Languages whose few figures are broadcast; beyond, joins are by shuffle.
FEW_LANGS = 10_000
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW_WORDS)], dtype=np.uint64)


def repeat_words(ids: np.ndarray) -> int:
    """Words in windows of eight that occur twice or more."""
    n = len(ids) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    wide = ids.astype(np.uint64)
    h = wide[:n] * _FACTORS[0]
    for k in range(1, WINDOW_WORDS):
        h += wide[k : k + n] * _FACTORS[k]
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():
        return 0
    # Hashes only rule windows out; those left are compared by their words.
    values, back, counts = np.unique(h, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[back] > 1)
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW_WORDS)[at]
    _, back, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    at = at[counts[back.reshape(-1)] > 1]
    edge[at] += 1
    edge[at + WINDOW_WORDS] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


class Block:
    """Words of some documents by number, and the n-grams of each word."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.chars = 0
        self.langs: list[str] = []
        self.ids: list[np.ndarray] = []

    def add(self, text: str, lang: str) -> np.ndarray:
        words, number = text.encode().split(), self.number
        for w in set(words).difference(number):
            number[w] = len(number)
        ids = np.array([number[w] for w in words], dtype=np.int32)
        self.chars += len(text)
        self.langs.append(lang)
        self.ids.append(ids)
        return ids

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Packed n-grams of all words, one word after the other; where each word's begin (and the end)."""
        words = [w.decode() for w in self.number]
        pad = ORDER - 1
        # Words' bounds are told from white space in a word by their places.
        cp = np.frombuffer("".join(chr(BEGIN) * pad + w + chr(END) for w in words).encode("utf-32-le"), dtype=np.uint32)
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1 + pad
        last = np.cumsum(lens) - 1
        control = cp < 32
        control[last] = False
        for k in range(pad):
            control[last - lens + 1 + k] = False
        cp = np.where(control, 1, cp)
        if (wide := cp > PLAIN).any():
            at = np.cumsum(1 + wide) - 1  # of each character's last symbol
            split = np.empty(int(at[-1]) + 1, np.uint32)
            split[at] = np.where(wide, cp & PLAIN, cp)
            split[at[wide] - 1] = PLAIN + 1 + (cp[wide] >> LOW_BITS)
            cp, last = split, at[last]
            lens = np.diff(last, prepend=-1)
        n = lens - pad
        spots = np.repeat(last - np.cumsum(n) + 1, n) + np.arange(int(n.sum()))
        code = np.zeros(len(spots), np.uint64)
        for k in range(ORDER):
            code |= cp[spots - k].astype(np.uint64) << np.uint64(CHAR_BITS * k)
        return code.view(np.int64), np.concatenate([[0], np.cumsum(n)])

    def by_lang(self) -> Iterator[tuple[str, list[int]]]:
        found: dict[str, list[int]] = {}
        for i, lang in enumerate(self.langs):
            found.setdefault(lang, []).append(i)
        yield from found.items()

    def counts(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Language, distinct n-grams and their counts."""
        if not self.number:
            return
        code, at = self.grams()
        lens = np.diff(at)
        for lang, docs in self.by_lang():
            times = np.bincount(np.concatenate([self.ids[i] for i in docs]), minlength=len(lens))
            weight = np.repeat(times, lens)
            used = np.flatnonzero(weight)
            if len(used):
                values, back = np.unique(code[used], return_inverse=True)
                yield lang, values, np.bincount(back, weights=weight[used]).astype(np.int64)

    def scores(self, model: str) -> np.ndarray:
        """Mean negative log probability a character of each document; NaN without words."""
        out = np.full(len(self.ids), np.nan)
        if not self.number:
            return out
        code, at = self.grams()
        values, back = np.unique(code, return_inverse=True)
        lens = np.diff(at)
        known = lookup(model, sorted(set(self.langs)), values)
        for lang, docs in self.by_lang():
            word = np.add.reduceat(known[lang][back], at[:-1])
            for i in docs:
                if len(self.ids[i]):
                    out[i] = -word[self.ids[i]].sum() / lens[self.ids[i]].sum()
        return out


_models: dict[str, dict[str, tuple[np.ndarray, np.ndarray]]] = {}


def _groups(model: str) -> Iterator[tuple[pq.ParquetFile, int]]:
    """All row groups of a model."""
    where, folder = fs.FileSystem.from_uri(model)
    for info in sorted(where.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                file = pq.ParquetFile(f)
                for g in range(file.num_row_groups):
                    yield file, g


def _arrays(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Language, n-grams and log probabilities of each run of a language."""
    lang = pa.Table.from_batches([table]).column(0) if isinstance(table, pa.RecordBatch) else table.column(0)
    lang = lang.combine_chunks().dictionary_encode()
    names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    codes, logp = table.column(1).to_numpy(), table.column(2).to_numpy()
    cuts = np.flatnonzero(np.diff(which)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(which)], strict=True):
        if b > a:
            yield names[which[a]], codes[a:b], logp[a:b]


def _held(model: str) -> dict[str, tuple[np.ndarray, np.ndarray]] | None:
    """The sorted arrays of a model by language, if it is small enough to be held."""
    if model not in _models:
        _models.clear()
        parts: dict[str, list] = {}
        if sum(file.metadata.row_group(g).num_rows for file, g in _groups(model)) <= HELD_GRAMS:
            for file, g in _groups(model):
                for lang, codes, logp in _arrays(file.read_row_group(g)):
                    parts.setdefault(lang, []).append((codes, logp))
            held = {x: (np.concatenate([c for c, _ in own]), np.concatenate([p for _, p in own])) for x, own in parts.items()}
            _models[model] = {x: (c[o], p[o]) for x, (c, p) in held.items() for o in [np.argsort(c, kind="stable")]}
        else:
            _models[model] = None
    return _models[model]


def lookup(model: str, langs: list[str], values: np.ndarray) -> dict[str, np.ndarray]:
    """Log probabilities of sorted n-grams by language; 0 for those that a language lacks."""
    out = {x: np.zeros(len(values)) for x in langs}

    def put(lang: str, codes: np.ndarray, logp: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(codes, values), len(codes) - 1)
        hit = np.flatnonzero(codes[at] == values)
        out[lang][hit] = logp[at[hit]]

    if (held := _held(model)) is not None:
        for lang in langs:
            if lang in held:
                put(lang, *held[lang])
        return out
    low, high = int(values[0]), int(values[-1])
    for file, g in _groups(model):
        of_lang, of_code = (file.metadata.row_group(g).column(c).statistics for c in (0, 1))
        if of_lang and of_lang.has_min_max and not any(of_lang.min <= x <= of_lang.max for x in langs):
            continue
        if of_lang and of_code and of_lang.has_min_max and of_code.has_min_max and of_lang.min == of_lang.max and (of_code.max < low or of_code.min > high):
            continue
        for b in file.iter_batches(1 << 18, row_groups=[g]):
            for lang, codes, logp in _arrays(b):
                if lang in out:
                    put(lang, codes, logp)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(block: Block) -> Iterator[pa.RecordBatch]:
        for lang, values, counts in block.counts():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], names=["lang", "code", "n"])
        trim()

    block = Block()
    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            block.add(text or "", "" if lang is None else "=" + lang)
            if block.chars >= BLOCK_CHARS:
                yield from out(block)
                block = Block()
    yield from out(block)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, code (n-gram of the highest order) and n, over whole texts of all documents."""
    rows = bounded_batches(docs).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> Column:
    return F.col("code").bitwiseAND(F.lit((1 << (CHAR_BITS * order)) - 1))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, code and logp of every counted n-gram, interpolated through all orders.

    A context has 4,096 followers at most, so the windows over contexts are small.
    """
    few = counts.select("lang").distinct().limit(FEW_LANGS + 1).count() <= FEW_LANGS
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        begins = F.shiftrightunsigned("code", CHAR_BITS * (k - 1)) == BEGIN
        levels[k] = levels[k + 1].select("lang", _suffix(k).alias("code"), "n").groupBy("lang", "code").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).select("lang", "code", F.when(begins, F.col("all")).otherwise(F.col("kinds")).alias("n"))
    lower: DataFrame | None = None
    for k in range(1, ORDER + 1):
        rows = levels[k]
        times = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = lambda i: F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).otherwise(F.lit(0.5))
        cuts = rows.groupBy("lang").agg(*times).select("lang", *[F.expr("0.0").alias("d0")], *[cut(i).alias(f"d{i}") for i in (1, 2, 3)])
        w = Window.partitionBy("lang", "ctx")
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.join(F.broadcast(cuts) if few else cuts, "lang").select("lang", "code", "n", discount.alias("d"), F.shiftrightunsigned("code", CHAR_BITS).alias("ctx"))
        rows = rows.select("lang", "code", ((F.col("n") - F.col("d")) / F.sum("n").over(w)).alias("own"), (F.sum("d").over(w) / F.sum("n").over(w)).alias("rest"))
        if lower is None:
            lower = rows.select("lang", "code", (F.col("own") + F.col("rest") / (1 << CHAR_BITS)).alias("p"))
        else:
            below = lower.select("lang", F.col("code").alias("tail"), F.col("p").alias("low"))
            lower = rows.withColumn("tail", _suffix(k - 1)).join(below, ["lang", "tail"]).select("lang", "code", (F.col("own") + F.col("rest") * F.col("low")).alias("p"))
    return lower.select("lang", "code", F.log("p").cast("float").alias("logp"))


def build_model(docs: DataFrame) -> str:
    """The folder of the model of these documents."""
    spark = docs.sparkSession
    counted, model = shared_dir(spark, "gram-counts"), shared_dir(spark, "gram-model")
    count_grams(docs).write.parquet(counted)
    counts = spark.read.schema("lang string, code long, n long").parquet(counted)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kneser_ney(counts).repartitionByRange(n, "lang", "code").sortWithinPartitions("lang", "code").write.parquet(model)
    return model


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"
_NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def _measured(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    def out(block: Block, held: list[pa.RecordBatch], base: list[tuple]) -> Iterator[pa.RecordBatch]:
        scores, at = block.scores(model), 0
        columns = [np.array(c, dtype=np.int64) for c in zip(*base, strict=True)]
        for b in held:
            part = slice(at, at := at + b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c[part]) for c in columns], pa.array(scores[part], from_pandas=True)], names=[*b.schema.names, *[P + x for x in _NAMES]])
        trim()

    block, held, base = Block(), [], []
    for b in batches:
        texts, langs, begin = b.column(b.schema.get_field_index("text")).to_pylist(), b.column(b.schema.get_field_index(P + "lang")).to_pylist(), 0
        for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
            text = text or ""
            ids = block.add(text, "" if lang is None else "=" + lang)
            base.append((len(ids), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup_lines(text), repeat_words(ids)))
            if block.chars >= BLOCK_CHARS:
                held.append(b.slice(begin, i + 1 - begin))
                begin = i + 1
                yield from out(block, held, base)
                block, held, base = Block(), [], []
        if begin < b.num_rows:
            held.append(b.slice(begin))
    if held:
        yield from out(block, held, base)


def measured(docs: DataFrame, model: str) -> DataFrame:
    """docs with the measures in columns of an internal prefix, row by row and without a shuffle; text must be a string."""
    rows = bounded_batches(docs).select("*", F.col("lang").cast("string").alias(P + "lang"))
    names = ", ".join(P + x for x in MEASURES.split(", "))
    kind = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda it: _measured(it, model), f"{kind}, {names}")


def base_failed(prefix: str = P) -> Column:
    return (F.col(prefix + "n_words") < 20) | (100 * F.col(prefix + "n_repeat_words") > 30 * F.col(prefix + "n_words"))


def _spread() -> Column:
    return F.sqrt(1 + F.lit(float(SPREAD_CHARS)) / F.greatest(F.col(P + "word_chars") + F.col(P + "n_words"), F.lit(1)))


def bands(scores: DataFrame) -> DataFrame:
    """Language (null-safe key), middle and deviation of the documents that pass the base rules."""
    rows = scores.where(~base_failed()).select(F.coalesce(F.concat(F.lit("="), P + "lang"), F.lit("")).alias(P + "key"), F.col(P + "log_perplexity").alias("x"), _spread().alias("s"))
    middle = rows.groupBy(P + "key").agg(F.percentile_approx("x", 0.5, 10000).alias("m"))
    away = F.abs(F.col("x") - F.col("m")) / F.col("s")
    few = middle.limit(FEW_LANGS + 1).count() <= FEW_LANGS
    spread = rows.join(F.broadcast(middle) if few else middle, P + "key").groupBy(P + "key", "m").agg(F.greatest(F.percentile_approx(away, 0.5, 10000), F.lit(LEAST_SPREAD)).alias("d"))
    return spread.select(P + "key", F.col("m").alias(P + "middle"), F.col("d").alias(P + "deviation"))


def judged(rows: DataFrame, band: DataFrame) -> DataFrame:
    """rows of measured() with base_failed and kept under the internal prefix; band: what bands gives."""
    few = band.limit(FEW_LANGS + 1).count() <= FEW_LANGS
    key = F.coalesce(F.concat(F.lit("="), P + "lang"), F.lit(""))
    found = rows.withColumn(P + "key", key).join(F.broadcast(band) if few else band, P + "key", "left")
    away = (F.col(P + "log_perplexity") - F.col(P + "middle")) / (F.col(P + "deviation") * _spread())
    inside = F.coalesce(away.between(-LOWER, UPPER), F.lit(False))
    marked = found.withColumn(P + "base_failed", base_failed()).withColumn(P + "kept", ~F.col(P + "base_failed") & inside)
    return marked.select(*rows.columns, P + "base_failed", P + "kept")
