"""Operator 2: byte-level BPE encoding and decoding with a segment tree.

A pre-token's bytes are symbols; a segment tree's leaves hold the merge rank of each adjacent pair with its place.
The root is the leftmost pair of the lowest rank; a merge changes three leaves, each a logarithmic update, and the
work ends when the root says that no pair merges.  A pre-token of n bytes costs O(n log n) however long it is.
Pieces of texts that came before are looked up (a bounded cache).  Short new pre-tokens of a batch
are merged together: their trees are rows of one numpy array for each tree size, and a step takes every row's root.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, lean
from .encode import PieceCache, runs

#: Unicode White_Space, as the pre-tokenizers' ``\s`` has it (fixed values).
WHITE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level pre-tokenizer's pattern with its white space spelled out (fixed values).
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

_NONE = 1 << 62

_codecs: dict[str, "Codec"] = {}


def codec(path: str) -> "Codec":
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """``max_known`` bounds the cache of pieces, never the work."""

    def __init__(self, path: str, max_known: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(max(vocab.values()), *special.values())
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.special = special
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.byte_ids = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[int, tuple[int, int]] = {}  # left << 20 | right -> rank, merged id
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        keys = sorted(self.merges)
        self.merge_keys = np.array(keys, np.int64)
        self.merge_ranks = np.array([self.merges[k][0] for k in keys], np.int64)
        self.merge_ids = np.array([self.merges[k][1] for k in keys], np.int64)
        self.byte_table = np.array(self.byte_ids, np.int64)
        self.pattern = regex.compile(PRETOKEN)
        self.cache = _Pieces(self, size, max_known)
        self.token_flat, self.token_at, self.token_size = _flat(self.token_bytes)
        self.decimal_flat, self.decimal_at, self.decimal_size = _flat([f"{x},".encode() for x in self.decimal])

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ids = [self.byte_ids[b] for b in raw]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        get, none = self.merges.get, 1 << 62
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [none] * (2 * size)
        target = [0] * n
        for i in range(n - 1):
            if m := get(ids[i] << 20 | ids[i + 1]):
                tree[size + i] = m[0] << 32 | i
                target[i] = m[1]
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while (root := tree[1]) != none:
            i = root & 0xFFFFFFFF
            gone = after[i]
            ids[i] = target[i]
            ids[gone] = -1
            nxt = after[i] = after[gone]
            if gone < n - 1 or size > gone:
                if tree[size + gone] != none:
                    put(gone, none)
            value = none
            if nxt < n:
                before[nxt] = i
                if m := get(ids[i] << 20 | ids[nxt]):
                    value, target[i] = m[0] << 32 | i, m[1]
            put(i, value)
            if (p := before[i]) >= 0:
                value = none
                if m := get(ids[p] << 20 | ids[i]):
                    value, target[p] = m[0] << 32 | p, m[1]
                if tree[size + p] != value:
                    put(p, value)
        return tuple(x for x in ids if x >= 0)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE: no merge) and merged id of each pair; a symbol of -1 merges with nothing."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        found = (self.merge_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.merge_ranks[at], _NONE), self.merge_ids[at]

    def _merge_rows(self, raws: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        """``merge`` for pre-tokens of at most ``leaves`` + 1 bytes, one tree a row."""
        n, wide = len(raws), leaves + 2
        sizes = np.fromiter(map(len, raws), np.int64, n)
        ids = np.full((n, wide), -1, np.int64)
        filled = np.arange(wide) < sizes[:, None]
        ids[filled] = self.byte_table[np.frombuffer(b"".join(raws), np.uint8)]
        after = np.tile(np.arange(1, wide + 1), (n, 1))
        after[:, -1] = wide - 1
        before = np.tile(np.arange(-1, wide - 1), (n, 1))
        rank, target = self._pairs(ids[:, :leaves], ids[:, 1 : leaves + 1])
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        tree[:, leaves:] = np.where(rank == _NONE, _NONE, rank << 32 | np.arange(leaves))
        for k in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        flat = tree.reshape(-1)

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            base, k = rows * (2 * leaves), leaf + leaves
            flat[base + k] = value
            for _ in range(leaves.bit_length() - 1):
                k = k >> 1
                flat[base + k] = np.minimum(flat[base + 2 * k], flat[base + 2 * k + 1])

        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            i = tree[rows, 1] & 0xFFFFFFFF
            gone = after[rows, i]
            new = target[rows, i]
            ids[rows, i], ids[rows, gone] = new, -1
            nxt = after[rows, gone]
            after[rows, i] = nxt
            inside = nxt < wide - 1
            before[rows[inside], nxt[inside]] = i[inside]
            some = gone < leaves
            put(rows[some], gone[some], _NONE)
            rank, made = self._pairs(new, np.where(inside, ids[rows, nxt], -1))
            target[rows, i] = np.where(rank != _NONE, made, target[rows, i]) if leaves > 1 else made
            put(rows, i, np.where(rank == _NONE, _NONE, rank << 32 | i))
            p = before[rows, i]
            some = p >= 0
            r, q = rows[some], p[some]
            rank, made = self._pairs(ids[r, q], new[some])
            target[r, q] = made
            put(r, q, np.where(rank == _NONE, _NONE, rank << 32 | q))
            rows = rows[tree[rows, 1] != _NONE]
        keep = ids >= 0
        ends = np.cumsum(keep.sum(1)).tolist()
        out = ids[keep].tolist()
        return [tuple(out[a:b]) for a, b in zip([0, *ends], ends)]

    def learn(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of each piece: its pre-tokens merged, special tokens as they are."""
        parts: list[tuple] = []
        lacking: set[str] = set()
        for piece in pieces:
            bare = piece[1:] if piece[0] == " " else piece
            if bare.isalpha() and max(bare) < "\u0100":  # a word is one pre-token
                tokens = (piece,)
            elif self.special_split and self.special_split.search(piece):
                tokens = tuple(x for part in self.special_split.split(piece) for x in ([self.special[part]] if part in self.special else self.pattern.findall(part)))
            else:
                tokens = tuple(self.pattern.findall(piece))
            lacking.update(t for t in tokens if isinstance(t, str))
            parts.append(tokens)
        made: dict[str | int, tuple[int, ...]] = {i: (i,) for i in self.special.values()}
        classes: dict[int, list[str]] = {}
        for t in lacking:
            n = len(t.encode())
            if n > 65:
                made[t] = self.merge(t.encode())
            else:
                classes.setdefault(1 << max(n - 2, 0).bit_length(), []).append(t)
        for leaves, own in classes.items():
            for k in range(0, len(own), 8192):
                some = own[k : k + 8192]
                made.update(zip(some, self._merge_rows([t.encode() for t in some], leaves)))
        return [made[p[0]] if len(p) == 1 else tuple(chain.from_iterable(map(made.__getitem__, p))) for p in parts]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.cache.encode(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def _flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings one after another, where each begins, and their sizes."""
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(sizes) - sizes, sizes


class _Pieces(PieceCache):
    """Pieces' ids by the segment trees of a codec."""

    def __init__(self, owner: Codec, n_ids: int, max_pieces: int):
        self.owner = owner
        super().__init__(n_ids, max_pieces, 64)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.owner.learn([p.decode() for p in pieces])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(c: Codec, batch: pa.RecordBatch, most: int = 256) -> Iterator[list[int]]:
    for k in range(0, batch.num_rows, most):
        yield from c.encode_batch(batch.column("text").slice(k, most).to_pylist())


def _joined(ids: np.ndarray, edges: np.ndarray, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
    """For each text, the byte strings of its ids one after another."""
    n = sizes[ids]
    raw = flat[runs(at[ids], n)].tobytes()
    ends = np.concatenate([[0], np.cumsum(n)])[edges].tolist()
    return (raw[a:b] for a, b in zip(ends, ends[1:]))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the sha256 of the ids and of the text decoded from them.

    A null or empty text has no ids; every row has one result, repeated rows too.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids, counts = c.cache.encode_column(part.column("text"))
                edges = np.concatenate([[0], np.cumsum(counts)])
                numbers, texts = (_joined(ids, edges, *x) for x in ((c.decimal_flat, c.decimal_at, c.decimal_size), (c.token_flat, c.token_at, c.token_size)))
                a = [hashlib.sha256(x[:-1]).hexdigest() for x in numbers]  # the last id has no comma
                b = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(a, pa.string()), pa.array(b, pa.string())], schema=schema)

    return documents(docs).mapInArrow(lean(run), DIGESTS)


def encode_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(encoded(c, batch)), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents(docs).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text decoded from ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(x.as_py() or []) for x in batch.column("ids")], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")
