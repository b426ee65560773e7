"""Token ids of whole texts by the ``tokenizers`` library, with each distinct piece encoded once.

Both tokenizers' pre-tokenizers never join a character with the white space after it: no pre-token, normaliser
or special token of theirs crosses the place before a white-space run that follows other characters.  Nor does one
hold a letter with a following symbol of ``CUT``, or a lone line feed with what follows.  Texts are cut at these places,
the library encodes each distinct piece, and a text's ids are its pieces' ids in order.  Tests hold this
against whole-text encoding.

Places are found on the UTF-8 bytes of many texts at once.  Known pieces are held in flat arrays behind an open
hash table; a piece found by its hash is compared byte by byte, so a clash of hashes never gives another piece's ids.
New pieces go to the library many at a time: words of Latin letters, which are one pre-token each, straight to its BPE
model, with a separator of an id of its own between them, everything else through the whole tokenizer.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from .hashed import mix

#: White space of one byte, and of more: lead bytes and the last bytes that go with them (Unicode White_Space; fixed values).
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WHITE_2 = (0xC2, (0x85, 0xA0))
_WHITE_3 = (((0xE1, 0x9A), (0x80,)), ((0xE2, 0x80), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), ((0xE2, 0x81), (0x9F,)), ((0xE3, 0x80), (0x80,)))
#: Symbols that begin a piece after a letter; ``'`` (contractions) and those of special tokens are not among them.
CUT = np.isin(np.arange(256), list(b".,;:!?&#*$%\"()[]{}/\\-=+@^~`"))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: Last bytes of Latin-1 letters behind the lead byte C3.
_LATIN = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {chr(b): chr(c) for b, c in [*zip(_SELF, _SELF), *zip((x for x in range(256) if x not in set(_SELF)), range(256, 512))]}
_TO_ALPHABET = str.maketrans(_ALPHABET)

_encoders: dict[str, "PieceEncoder"] = {}


def encoder(path: str) -> "PieceEncoder":
    """One encoder for each vocabulary in a Python worker; its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def piece_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Byte places at which pieces begin; every text's start is one."""
    n = len(raw)
    white = _WHITE[raw]
    lead = np.flatnonzero(raw[:-1] == _WHITE_2[0])
    lead = lead[np.isin(raw[lead + 1], _WHITE_2[1])]
    white[lead] = white[lead + 1] = True
    for (a, b), last in _WHITE_3:
        lead = np.flatnonzero(raw[: max(n - 2, 0)] == a)
        if len(lead):
            lead = lead[(raw[lead + 1] == b) & np.isin(raw[lead + 2], last)]
            white[lead] = white[lead + 1] = white[lead + 2] = True
    begin = np.zeros(n, bool)
    begin[1:] = white[1:] & ~white[:-1]
    letter = _LETTER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    letter[lead] = _LATIN[raw[lead]]
    begin[1:] |= CUT[raw[1:]] & letter[:-1]
    feed = np.flatnonzero(raw[1:-1] == 10) + 1  # a lone line feed before other characters
    begin[feed[~white[feed - 1] & ~white[feed + 1]] + 1] = True
    begin[starts[starts < n]] = True
    return np.flatnonzero(begin)


class _Grown:
    """A flat array that doubles its room as it is appended to."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1024, kind), 0

    def append(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            more = np.zeros(max(2 * len(self.data), self.n + len(values)), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def cut(self, n: int) -> None:
        self.n = n


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... (n of them) of each run, one run after another."""
    n = n.astype(np.int64)
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start.astype(np.int64) - (ends - n), n)


class PieceCache:
    """Ids of texts from ids of their pieces, each learnt once by ``_learn``; ``max_pieces`` and ``max_piece_bytes`` bound the
    memory, never the work.  Ids are below ``n_ids``."""

    def __init__(self, n_ids: int, max_pieces: int, max_piece_bytes: int):
        self.max_pieces, self.max_piece_bytes = max_pieces, max_piece_bytes
        self.kind = np.uint16 if n_ids <= 1 << 16 else np.uint32
        self._reset()

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        raise NotImplementedError

    def _reset(self) -> None:
        self.arena, self.pos, self.length = _Grown(np.uint8), _Grown(np.uint32), _Grown(np.uint16)
        self.flat, self.off, self.count = _Grown(self.kind), _Grown(np.int64), _Grown(np.uint32)
        self.hash, self.used = _Grown(np.uint64), _Grown(bool)
        self._table(1 << 12)

    def _table(self, size: int) -> None:
        self.slots, self.shift = np.full(size, -1, np.int32), np.uint64(64 - (size.bit_length() - 1))
        self._place(np.arange(self.hash.n))

    def _place(self, entries: np.ndarray) -> None:
        """Put entries (of different hashes) into the table."""
        at, mask = (self.hash.data[entries] >> self.shift).astype(np.int64), len(self.slots) - 1
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            left = self.slots[at] != entries
            entries, at = entries[left], (at[left] + 1) & mask

    def _make_room(self, more: int) -> None:
        """Before the cache overflows, only pieces that were met again stay, or none if those are many."""
        n = self.hash.n
        if n + more > self.max_pieces:
            keep = np.flatnonzero(self.used.data[:n])
            if len(keep) + more > self.max_pieces // 2:
                self._reset()
            else:
                pos, length, off, count, hashes = (x.data[keep] for x in (self.pos, self.length, self.off, self.count, self.hash))
                arena, flat = self.arena.data[runs(pos, length)], self.flat.data[runs(off, count)]
                self._reset()
                self._append(arena, length, flat, count, hashes)
        while 2 * (self.hash.n + more) > len(self.slots):
            self._table(4 * len(self.slots))

    def _append(self, arena: np.ndarray, length: np.ndarray, flat: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> None:
        first = self.hash.n
        self.pos.append(self.arena.n + np.cumsum(length, dtype=np.int64) - length)
        self.off.append(self.flat.n + np.cumsum(count, dtype=np.int64) - count)
        for grown, values in ((self.arena, arena), (self.length, length), (self.flat, flat), (self.count, count), (self.hash, hashes), (self.used, np.zeros(len(count), bool))):
            grown.append(values)
        while 2 * self.hash.n > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int32)
            self.shift = np.uint64(64 - (len(self.slots).bit_length() - 1))
            first = 0
        self._place(np.arange(first, self.hash.n))

    def _hashes(self, lanes: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        h, at, k = n.astype(np.uint64) * _STEP, None, 0
        while True:
            own, size = (s, n) if at is None else (s[at], n[at])
            v = lanes[own + 8 * k] & _MASK[np.minimum(size - 8 * k, 8)]
            if at is None:
                h = mix((h ^ v) * _STEP)
            else:
                h[at] = mix((h[at] ^ v) * _STEP)
            k += 1
            at = np.flatnonzero(n > 8 * k) if at is None else at[size > 8 * k]
            if not len(at):
                return h

    def _find(self, lanes: np.ndarray, s: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each piece; -1: not known; -2: another piece has its hash."""
        at, mask, known = (h >> self.shift).astype(np.int64), len(self.slots) - 1, self.hash.data
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (known[found] != h))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found[open_] = e = self.slots[at[open_]]
            open_ = open_[(e >= 0) & (known[e] != h[open_])]
        here = np.flatnonzero(found >= 0)
        arena = _lanes(self.arena.data)
        e, k = found[here], 0
        found[here[self.length.data[e] != n[here]]] = -2
        while len(here):
            e, size = found[here], n[here]
            pos = self.pos.data[e].astype(np.int64)
            wrong = ((lanes[s[here] + 8 * k] ^ arena[np.minimum(pos + 8 * k, len(arena) - 1)]) & _MASK[np.minimum(size - 8 * k, 8)]) != 0
            if wrong.any():
                found[here[wrong]] = -2
            k += 1
            here = here[(size > 8 * k) & ~wrong & (e >= 0)]
        return found

    def _entries(self, raw: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The entry of each piece, new ones learnt; entries past ``self.hash.n`` hold for this call only."""
        lanes = _lanes(raw)
        short = n <= self.max_piece_bytes
        entry = np.full(len(s), -1, np.int64)
        rows = np.flatnonzero(short)
        at, size = s[rows], n[rows]
        h = self._hashes(lanes, at, size)
        found = self._find(lanes, at, size, h)
        self.used.data[found[found >= 0]] = True
        if (found < 0).any():
            new = np.flatnonzero(found == -1)
            keys, first = np.unique(h[new], return_index=True)
            before = self.hash.n
            self._make_room(len(keys))
            one = new[first]
            ids, count = self._learn([raw[a : a + k].tobytes() for a, k in zip(at[one].tolist(), size[one].tolist())])
            kept = self.hash.n
            self._append(raw[runs(at[one], size[one])], size[one], ids, count, keys)
            again = new if kept == before else np.arange(len(rows))  # entries moved when room was made
            found[again] = self._find(lanes, at[again], size[again], h[again])
            if (found == -1).any():  # known before room was made: learn what is needed again
                lost = np.flatnonzero(found == -1)
                keys, first = np.unique(h[lost], return_index=True)
                one = lost[first]
                ids, count = self._learn([raw[a : a + k].tobytes() for a, k in zip(at[one].tolist(), size[one].tolist())])
                self._append(raw[runs(at[one], size[one])], size[one], ids, count, keys)
                found[lost] = self._find(lanes, at[lost], size[lost], h[lost])
        entry[rows] = found
        passing = np.flatnonzero(entry < 0)  # too long to keep, or a clash of hashes
        if len(passing):
            ids, count = self._learn([raw[s[k] : s[k] + n[k]].tobytes() for k in passing.tolist()])
            entry[passing] = self.off.n + np.arange(len(passing))
            self.off.append(self.flat.n + np.cumsum(count) - count)
            self.flat.append(ids)
            self.count.append(count)
        return entry

    def _encode(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after another in ``raw`` (padded by 8 bytes), and how many each has."""
        body = raw[:-8]
        if not len(body):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        s = piece_starts(body, starts)
        entry = self._entries(raw, s, np.diff(s, append=len(body)))
        count = self.count.data[entry].astype(np.int64)
        ids = self.flat.data[runs(self.off.data[entry], count)].astype(np.uint32)
        kept = self.hash.n
        if self.off.n > kept:
            self.flat.cut(int(self.off.data[kept]))
            self.off.cut(kept)
            self.count.cut(kept)
        total = np.concatenate([[0], np.cumsum(count)])
        edge = total[np.searchsorted(s, np.append(starts, len(body)))]
        return ids, np.diff(edge)

    def encode_flat(self, raw: np.ndarray, edges: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``raw[edges[k]:edges[k + 1]]`` one after another, and how many each has.

        About ``at_once`` bytes are worked on at a time; a longer text is cut before white space, where a piece begins anyway.
        """
        ids, counts = [], np.zeros(len(edges) - 1, np.int64)
        pad, first, last = np.zeros(8, np.uint8), int(edges[0]), int(edges[-1])
        while first < last:
            stop = min(first + at_once, last)
            if stop < last:
                k = int(np.searchsorted(edges, stop, side="right")) - 1
                if edges[k] > first:
                    stop = int(edges[k])
                else:
                    stop = self._white_place(raw, first, stop, int(edges[k + 1]))
            a, b = int(np.searchsorted(edges, first, side="right")) - 1, int(np.searchsorted(edges, stop, side="left"))
            starts = np.maximum(edges[a:b], first) - first
            own, n = self._encode(np.concatenate([raw[first:stop], pad]), starts)
            ids.append(own)
            counts[a:b] += n
            first = stop
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts

    @staticmethod
    def _white_place(raw: np.ndarray, first: int, stop: int, end: int) -> int:
        """The first place from ``stop`` where white space follows another character of one byte, or the text's end."""
        while stop < end:
            part = raw[stop - 1 : min(stop + (1 << 20), end)]
            at = np.flatnonzero(_WHITE[part[1:]] & ~_WHITE[part[:-1]] & (part[:-1] < 128))
            if len(at):
                return stop + int(at[0])
            stop += len(part) - 1
            if len(part) < 2:
                break
        return end

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode_flat`` of an Arrow column of strings without nulls."""
        wide = column.cast(pa.large_string())
        _, offsets, data = wide.buffers()
        edges = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return self.encode_flat(raw, edges)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


class PieceEncoder(PieceCache):
    """Pieces are encoded by the ``tokenizers`` library."""

    def __init__(self, path: str, max_pieces: int = 500_000, max_piece_bytes: int = 64):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.drops_space, self.lowers = ids("a ") == ids("a"), ids("A") == ids("a")
        self.words = Tokenizer(self.tokenizer.model)
        mark = _ALPHABET["\n"]
        self.words.pre_tokenizer = pre_tokenizers.Split(mark, "isolated")
        self.mark_id = self.words.encode(mark).ids
        super().__init__(self.tokenizer.get_vocab_size(with_added_tokens=True), max_pieces, max_piece_bytes)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the library, one after another, and how many each has."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        words, other = [], []
        for k, p in enumerate(pieces):
            t = p.decode()
            bare = t[1:] if t[0] == " " else t
            if bare.isalpha() and max(bare) < "Ā" and len(bare) < 256:
                words.append((k, (bare if self.drops_space else t).lower() if self.lowers else t))
            else:
                other.append((k, t))
        for first in range(0, len(words), 2048):
            part = words[first : first + 2048]
            text = "\n".join([t for _, t in part]).encode().decode("latin-1").translate(_TO_ALPHABET)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark_id[0]), len(ids)) if len(self.mark_id) == 1 else []
            if len(ends) != len(part):
                other += [(k, pieces[k].decode()) for k, _ in part]
                continue
            last = 0
            for (k, _), e in zip(part, ends.tolist()):
                out[k] = ids[last:e]
                last = e + 1
        for first in range(0, len(other), 2048):
            part = other[first : first + 2048]
            for (k, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)):
                out[k] = np.array(e.ids, np.uint32)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.fromiter(map(len, out), np.int64, len(out))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after each text's, and where each text's begin (and the last one's end)."""
    edges = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(int(edges[-1]), "<u4")
    ends = edges[1:] - 1
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own], out[ends] = ids, end_id
    return out, edges


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
