"""Encoding with public tokenizer files on the executors.

TreeEncoder encodes as the library does, byte-level BPE, and long texts by tree concatenation: a text is
halved, unsplit, until a leaf is short, the leaves are encoded side by side, and at each join a window of the
text on both sides is encoded again, a wider one until it agrees with both. Short texts, leaves and windows that are
Latin-1 are cut into pre-tokens here, each distinct one of which goes through the library's model once; others go
to the library whole. ChunkEncoder encodes likewise with tokenizers that drop white space.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.llm.common import bounded_batches, trim, whole_text

#: A text of more characters than this is encoded as a tree.
LONG_TEXT = 4096
#: Leaves of a tree, in characters.
LEAF = 2048
#: Tokens on either side of a join that are encoded again at first.
WINDOW = 8
#: Pre-tokens that an encoder remembers at most; then it begins anew.
REMEMBERED = 1_200_000
#: Characters handed to the library at once.
BATCH_CHARS = 1 << 21


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Ids(dict):
    """Ids of pre-tokens; a missing one is encoded by the library's model."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize
        self.alphabet = {b: c for c, b in _byte_of_char().items()}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED // 2:
            self.clear()
        self[piece] = ids = tuple([t.id for t in self.tokenize("".join(map(self.alphabet.__getitem__, piece.encode())))])
        return ids


#: Latin-1's letters and digits, as classes of the pre-tokenizers' patterns, and characters that Python alone counts as white space.
_LETTERS, _DIGITS, _ODD = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", re.compile("[\x1c-\x1f\x85]")


class TreeEncoder:
    _odd = _ODD
    _cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\\s{_LETTERS}{_DIGITS}]+|\\s+(?!\\S)|\\s+")

    def __init__(self, path: str, long_text: int = LONG_TEXT, leaf: int = LEAF, window: int = WINDOW):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.long_text, self.leaf, self.window = long_text, leaf, window
        self.joins = 0  # made so far
        self._plain, self._ids = byte_level(path), _Ids(self.tok.model)
        added = self.tok.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        alphabet = _byte_of_char()
        self.bytes_of = [b""] * self.tok.get_vocab_size(with_added_tokens=True)
        for piece, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = piece.encode() if i in added else bytes(alphabet[c] for c in piece)
        # White space behind another character parts pre-tokens, whatever stands around: no match of the pattern
        # holds the one after the other, and none looks back. Texts without such places for long have _long pieces.
        self._long = re.compile(r"[^ \t\n\r]{%d,}|\s{%d,}" % (leaf + 1, leaf + 1))
        self._opens = [b[:1] in (b" ", b"\t", b"\n", b"\r") for b in self.bytes_of]
        self._closes = [0x21 <= b[-1] <= 0x7E if b else False for b in self.bytes_of]
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _library(self, texts: Sequence[str]) -> list[list[int]]:
        """The ids of each text without trees."""
        out: list[list[int]] = [[]] * len(texts)
        whole, cut, ids_of = [], self._cut.findall, self._ids.__getitem__
        for i, t in enumerate(texts):
            if self._plain and _latin(t) and not (self._odd.search(t) or any(x in t for x in self.special)):
                out[i] = [*chain.from_iterable(map(ids_of, cut(t)))]
            else:
                whole.append(i)
        for i, e in zip(whole, self.tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode_all(self, texts: Sequence[str]) -> list[list[int]]:
        """The ids of each text, as the library's."""
        plain = [i for i, t in enumerate(texts) if len(t) <= self.long_text]
        out: list[list[int]] = [[]] * len(texts)
        for i, ids in zip(plain, self._library([texts[i] for i in plain]), strict=True):
            out[i] = ids
        parts: list[tuple[int, str]] = []  # of long texts, between special tokens
        for i in sorted({*range(len(texts))} - {*plain}):
            out[i] = []
            parts += [(i, p) for p in (self._split.split(texts[i]) if self._split else [texts[i]]) if p]
        trees = [p for _, p in parts if p not in self.special and not self._long.search(p)]
        made = iter(self._trees(trees))
        for i, p in parts:
            out[i] += [self.special[p]] if p in self.special else self._by_pieces(p) if self._long.search(p) else next(made)
        return out

    def _trees(self, texts: Sequence[str]) -> list[list[int]]:
        """Texts of short pieces, all of them level by level, so that the library gets many leaves and windows at once."""
        cuts = [range(0, len(t), self.leaf) for t in texts]
        leaves = iter(self._library([t[i : i + self.leaf] for t, own in zip(texts, cuts, strict=True) for i in own]))
        rows = [[next(leaves) for _ in own] for own in cuts]
        while any(len(r) > 1 for r in rows):
            pairs = [(r[k], r[k + 1]) for r in rows for k in range(0, len(r) - 1, 2)]
            joined = iter(self._joined(pairs))
            rows = [[next(joined) if k + 1 < len(r) else r[k] for k in range(0, len(r), 2)] for r in rows]
        return [r[0] for r in rows]

    def _joined(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The ids of neighbours as one.

        A window begins where white space follows another character on the left side, and ends before such a
        place on the right; what lies outside is then as it would be in the whole text.
        """
        out: list[list[int]] = [[]] * len(pairs)
        left, k = list(range(len(pairs))), self.window
        while left:
            self.joins += len(left)
            edges = [self._edges(*pairs[p], k) for p in left]
            windows = self._library([b"".join([self.bytes_of[x] for x in (*pairs[p][0][i:], *pairs[p][1][:j])]).decode() for p, (i, j) in zip(left, edges, strict=True)])
            again = []
            for p, (i, j), ids in zip(left, edges, windows, strict=True):
                a, b = pairs[p]
                if (i == 0 or ids[0] == a[i]) and (j == len(b) or ids[-1] == b[j - 1]):
                    out[p] = [*a[:i], *ids, *b[j:]]
                else:
                    again.append(p)
            left, k = again, 2 * k
        return out

    def _edges(self, a: list[int], b: list[int], k: int) -> tuple[int, int]:
        """Where a window of k tokens or more on either side of a join begins and ends."""
        i, j = max(0, len(a) - k), min(len(b), k)
        while i and not (self._opens[a[i]] and self._closes[a[i - 1]]):
            i -= 1
        while j < len(b) and not (self._opens[b[j]] and self._closes[b[j - 1]]):
            j += 1
        return i, j

    def _by_pieces(self, text: str) -> list[int]:
        """Pre-tokens are independent, so each is encoded by itself, the long ones as trees."""
        pieces = [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        short = [i for i, p in enumerate(pieces) if len(p) <= self.leaf]
        ids = dict(zip(short, self._library([pieces[i] for i in short]), strict=True))
        return [x for i, p in enumerate(pieces) for x in (ids[i] if i in ids else self.tree(p))]

    def tree(self, piece: str) -> list[int]:
        """One pre-token, by tree concatenation; its joins are anywhere in it."""
        leaves = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        with ThreadPoolExecutor(2) as pool:
            parts = list(pool.map(lambda x: self._library([x])[0], leaves))
            while len(parts) > 1:
                pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
                parts = list(pool.map(lambda p: self._concat(*p) if len(p) == 2 else p[0], pairs))
        return parts[0] if parts else []

    def _whole_chars(self, left: list[int], right: list[int], k: int) -> tuple[int, int, str]:
        """At least k tokens from either side of a join, as many more as it takes for whole characters."""
        i, j = max(0, len(left) - k), min(len(right), k)
        while True:
            data = b"".join(self.bytes_of[t] for t in [*left[i:], *right[:j]])
            if i and data[0] & 0xC0 == 0x80:
                i -= 1
            elif j < len(right) and self.bytes_of[right[j]][0] & 0xC0 == 0x80:
                j += 1
            else:
                return i, j, data.decode()

    def _concat(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbours as one.

        Ids are right if and only if each pair of neighbours among them is what the pair's own
        bytes encode to. If the window begins with the left side's token and ends with the
        right side's, every pair lies either in the window or in a side, and all are right.
        """
        k = self.window
        while True:
            self.joins += 1
            i, j, text = self._whole_chars(left, right, k)
            ids = self._library([text])[0]
            if (i == 0 or ids[0] == left[i]) and (j == len(right) or ids[-1] == right[j - 1]):
                return [*left[:i], *ids, *right[j:]]
            k *= 2

    def decode(self, ids: Sequence[int]) -> bytes:
        """UTF-8 of the decoded text, special tokens included; broken sequences become U+FFFD."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()


class _Pieces(dict):
    """Ids of pre-tokens, as bytes; a missing one is encoded by the library's model."""

    def __init__(self, model, width: str):
        super().__init__()
        self.tokenize, self.width = model.tokenize, width
        self.alphabet = {b: c for c, b in _byte_of_char().items()}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        level = piece if piece.isascii() and piece.isprintable() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        self[piece] = ids = np.array([t.id for t in self.tokenize(level)], dtype=self.width).tobytes()
        return ids


#: The components of a tokenizer that ChunkEncoder's own rules stand for, as its file names them.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


@lru_cache(8)
def drops_space(path: str) -> bool:
    """Whether a tokenizer lower-cases, drops white space and cuts words as _RULES say; any other one goes to its library whole."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    # Added tokens that are normalised, stripped or whole words would be found in other places.
    plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"])
    model = made["model"]
    same = model.get("type", "BPE") == "BPE" and not model.get("dropout") and model.get("continuing_subword_prefix") is None
    return plain and same and all(made[k] == v for k, v in _RULES.items())


@lru_cache(8)
def byte_level(path: str) -> bool:
    """Whether a tokenizer cuts texts by the usual byte-level pattern and no more, as _cut does for Latin-1."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    usual = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = made["model"]
    plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"])
    same = model.get("type", "BPE") == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    return plain and same and made["normalizer"] is None and made["pre_tokenizer"] == usual


class LibraryEncoder:
    """Any tokenizer: a .json file by tokenizers, another by sentencepiece."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()
            size = self.tok.get_vocab_size(with_added_tokens=True)
            self._ids = lambda texts: [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
            size = self.tok.vocab_size()
            self._ids = lambda texts: self.tok.encode(texts, num_threads=1)
        self.width = "<u2" if size <= 1 << 16 else "<u4"

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of the encoder's width."""
        return [np.asarray(x, dtype=self.width).tobytes() for x in self._ids(list(texts))] if texts else []


class ChunkEncoder(LibraryEncoder):
    """For tokenizers that lower-case, drop white space and cut words (drops_space).

    Latin-1 texts are cut into pre-tokens here (in that range the rules need no tables) and each
    distinct one goes through the library's model once. Other texts go to the library by chunks
    between white space, each distinct chunk once; texts with special tokens or with a control character that
    Python counts as white space and the library doesn't go to it whole.
    """

    _odd = _ODD
    _letters, _digits = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
    _cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_letters}]+|[{_digits}]|[^\\s{_letters}{_digits}]+")

    def __init__(self, path: str):
        super().__init__(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(self.tok.model, self.width)
        self.chunks: dict[str, bytes] = {}

    def _library(self, texts: Sequence[str]) -> list[bytes]:
        return super().encode_all(texts)

    def _by_chunks(self, texts: Sequence[str]) -> list[bytes]:
        chunks = [t.split() for t in texts]
        if len(self.chunks) > REMEMBERED // 4:
            self.chunks.clear()
        missed = list(set().union(*chunks).difference(self.chunks))
        self.chunks.update(zip(missed, self._library(missed), strict=True))
        return [b"".join(map(self.chunks.__getitem__, c)) for c in chunks]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of the encoder's width."""
        out: list[bytes] = [b""] * len(texts)
        whole, wide = [], []
        cut, pieces = self._cut.findall, self.pieces
        for i, t in enumerate(texts):
            if self._odd.search(t) or any(x in t for x in self.special):
                whole.append(i)
                continue
            try:
                t.encode("latin-1")
            except UnicodeEncodeError:
                wide.append(i)
                continue
            out[i] = b"".join([pieces[p] for p in cut(t.lower())])
        for at, ids in ((whole, self._library([texts[i] for i in whole])), (wide, self._by_chunks([texts[i] for i in wide]))):
            for i, x in zip(at, ids, strict=True):
                out[i] = x
        return out


@lru_cache(4)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


@lru_cache(4)
def encoder(path: str) -> LibraryEncoder:
    return ChunkEncoder(path) if drops_space(path) else LibraryEncoder(path)


def by_chars(texts: Sequence[str], most: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of texts of about so many characters together."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (the decoded text's UTF-8 bytes): a row for each row of docs.

    A null text is an empty one; an empty one has no ids; texts of any length are encoded
    whole; repeated rows give repeated results; other columns are left out.
    """
    return bounded_batches(docs).select("doc_id", whole_text().alias("text")).mapInArrow(lambda it: _encode_decode(it, path), "doc_id long, ids array<int>, decoded binary")


def _encode_decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = tree_encoder(path)
    for b in batches:
        ids, texts = b.column(0).cast(pa.int64()), b.column(1).to_pylist()
        for part in by_chars(texts):
            got = enc.encode_all(texts[part])
            yield pa.RecordBatch.from_arrays([ids[part], pa.array([np.asarray(x, dtype=np.int32) for x in got], pa.list_(pa.int32())), pa.array([enc.decode(x) for x in got], pa.binary())], names=["doc_id", "ids", "decoded"])


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, of encode_decode's ids and decoded text."""
    return bounded_batches(docs).select("doc_id", whole_text().alias("text")).mapInArrow(lambda it: _encode_digests(it, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode_digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = tree_encoder(path)
    as_text = [str(i) for i in range(len(enc.bytes_of))]
    for b in batches:
        rows, texts = b.column(0).cast(pa.int64()), b.column(1).to_pylist()
        n, ids, decoded = [], [], []
        for part in by_chars(texts):
            for x in enc.encode_all(texts[part]):
                n.append(len(x))
                ids.append(hashlib.sha256(",".join(map(as_text.__getitem__, x)).encode()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode(x)).hexdigest())
        yield pa.RecordBatch.from_arrays([rows, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    trim()
