"""Token counts with a digest cache.

Content is normalised (as the tokenizer's own normaliser may: white space at the ends goes and
line ends become \\n, neither of which a tokenizer that drops white space can see) and
digested, as is the tokenizer's file. Digests are joined to the counts in the cache;
only distinct missing contents are encoded, and what they give is appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.llm.common import bounded_batches, whole_text
from svloom.llm.tokenizing import by_chars, drops_space, encoder

CACHE = "content binary, tokenizer string, n_tokens long"


def normalise(text: str, drops: bool = True) -> str:
    return text.strip(" \t\r\n").replace("\r\n", "\n") if drops else text


@lru_cache(8)
def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def content_digest(text: str, drops: bool = True) -> bytes:
    """The digest of what a tokenizer sees of a text."""
    return hashlib.sha256(normalise(text, drops).encode()).digest()


def _digests(batches: Iterator[pa.RecordBatch], drops: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [content_digest(t, drops) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "content"])


def _packed(batches: Iterator[pa.RecordBatch], drops: bool) -> Iterator[pa.RecordBatch]:
    """Each content once in a batch, compressed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        rest: dict[bytes, bytes] = {}
        for t in b.column("text").to_pylist():
            if (key := content_digest(t, drops)) not in rest:
                rest[key] = pack.compress(normalise(t, drops).encode())
        yield pa.RecordBatch.from_arrays([pa.array(rest.keys(), pa.binary()), pa.array(rest.values(), pa.binary())], names=["content", "packed"])


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc, unpack, version = encoder(path), zstandard.ZstdDecompressor(), tokenizer_version(path)
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            texts = [unpack.decompress(x).decode() if x else "" for x in part.column(1).to_pylist()]
            n = [len(x) // int(enc.width[2]) for s in by_chars(texts) for x in enc.encode_all(texts[s])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content", "tokenizer", "n_tokens"])


def cached(docs: DataFrame, cache: str) -> DataFrame:
    try:
        return docs.sparkSession.read.schema(CACHE).parquet(cache)
    except AnalysisException:
        return docs.sparkSession.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens for each row of docs; cache is a folder that all executors see.

    path is a .json file of tokenizers or a .model file of sentencepiece. A null text is an empty one; empty texts have no tokens; repeated rows give repeated
    results; other columns are left out. The cache gets one row for each content that it
    lacked; a count that is appended twice (by two runs at once) is the same and read once.
    """
    text = bounded_batches(docs).select("doc_id", whole_text().alias("text"))
    version, drops = tokenizer_version(path), drops_space(path)
    known = cached(docs, cache).where(F.col("tokenizer") == version).select("content")
    distinct = text.select("text").mapInArrow(lambda it: _packed(it, drops), "content binary, packed binary").dropDuplicates(["content"])
    missing = distinct.join(known, "content", "left_anti")
    missing.mapInArrow(lambda it: _count(it, path), CACHE).write.mode("append").parquet(cache)
    rows = text.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(lambda it: _digests(it, drops), "doc_id long, n_bytes long, content binary")
    counts = cached(docs, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens")
