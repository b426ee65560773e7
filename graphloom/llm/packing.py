"""Operator 10: packing into sequences of at most 4096 tokens by bin completion.

Documents are encoded, end with an id, and only longer ones are cut.  Pieces are dealt at random to groups of
about 100,000; each group is packed on its own, which can cost one sequence a group.  In a group, equal
lengths are interchangeable, so packing works on counts by length (4096 of them at most): best-fit decreasing
gives the incumbent; if it is above the lower bound (ceil(sum / 4096), or more where long pieces share no
bin), depth-first bin completion looks for fewer sequences.  At each node the longest open piece opens a bin,
undominated fillings of any number of pieces around it are tried from the fullest, and a branch ends when its waste exceeds what one sequence fewer would leave.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean, rows_per_group, stage
from .encode import encoder, with_end

CAPACITY, END_ID, GROUP_ROWS = 4096, 1, 100_000
#: Nodes that the search may open in a group, where the incumbent stands when they are spent, and fillings first tried at each.
MAX_NODES, MAX_FILLINGS = 20_000, 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, copy (tells repeated rows apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids, edges = with_end(*enc.encode_column(part.column("text")), end_id)
                n = -(-np.diff(edges) // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                first = edges[row] + start
                length = np.minimum(edges[row + 1] - first, capacity)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(first.tolist(), length.tolist())]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), part.column("copy").take(take)], names=["doc_id", "piece", "start", "length", "ids_crc32", "copy"])

    return documents(docs).withColumn("copy", F.monotonically_increasing_id()).mapInArrow(lean(run), PIECES)


def best_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing on counts by length: lists of lengths, one a bin."""
    bins: list[list[int]] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r is open
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            fit = rooms >> length
            if fit:
                room = length + (fit & -fit).bit_length() - 1
                b = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms &= ~(1 << room)
                bins[b].append(length)
            else:
                room, b = capacity, len(bins)
                bins.append([length])
            if room := room - length:
                open_by_room[room].append(b)
                rooms |= 1 << room
    return bins


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: pieces above half the capacity share none, small ones only fit into what those leave."""
    n, size = np.cumsum(counts), np.cumsum(counts * np.arange(len(counts)))
    half = capacity // 2
    small = np.arange(1, half + 1)  # for each of them, pieces below it are left out
    alone, large = n[-1] - n[capacity - small], n[-1] - n[half]
    beside = (large - alone) * capacity - (size[capacity - small] - size[half])  # room beside large pieces that small ones fit in
    more = -(-(size[half] - size[small - 1] - beside) // capacity)
    return max(-(-int(size[-1]) // capacity), int((large + np.maximum(more, 0)).max(initial=0)))


def _within(f: tuple[int, ...], g: tuple[int, ...]) -> bool:
    """Pieces of ``f`` fit in place of pieces of ``g``, several for one or one for one."""
    rooms = list(g)
    for x in f:
        for k, r in enumerate(rooms):
            if x <= r:
                rooms[k] -= x
                break
        else:
            return False
    return True


def fillings(counts: np.ndarray, room: int, limit: int, least: int = 0) -> tuple[list[tuple[int, ...]], bool]:
    """Fillings of ``room`` by any number of open pieces, fullest first, without dominated ones; True: there may be more.

    Sums that pieces reach are the bits of a number for each length and all below it, so that only fillings of a sum
    are walked.  A filling is dominated when its pieces fit in place of those of a fuller one.  The list ends
    with ``limit`` fillings, after a fixed number of dominated ones for each, or below the sum ``least``.
    """
    lengths = [x for x in np.flatnonzero(counts[: room + 1]).tolist() if x]
    own, reach, mask = [min(int(counts[x]), room // x) for x in lengths], [1], (1 << (room + 1)) - 1
    for x, n in zip(lengths, own):
        r, k = reach[-1], 1
        while n > 0:
            r |= (r << (min(k, n) * x)) & mask
            n, k = n - k, 2 * k
        reach.append(r)

    def parts(i: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        i = min(i, bisect_right(lengths, total))
        while i and reach[i] >> total & 1:
            i -= 1
            x = lengths[i]
            for k in range(min(own[i], total // x), 0, -1):
                if reach[i] >> (total - k * x) & 1:
                    for rest in parts(i, total - k * x):
                        yield (x,) * k + rest

    kept: list[tuple[int, ...]] = []
    sums, looked = reach[-1], 0
    while sums and (total := sums.bit_length() - 1) >= least:
        sums ^= 1 << total
        for f in parts(len(lengths), total):
            if len(kept) == limit or looked == 8 * limit:
                return kept, True
            looked += 1
            if not any(_within(f, g) for g in kept):
                kept.append(f)
                if len(f) == 1 and f[0] == room:
                    return kept, False  # it is at least as good as every other
    return kept, False


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, max_nodes: int = MAX_NODES, max_fillings: int = MAX_FILLINGS) -> list[list[int]]:
    """As few bins as best fit and the bounded search find, for ``counts[length]`` pieces of each length.

    A node opens one bin or, of equal ones, as many as there are pieces for.  Where the first ``max_fillings`` of a
    node fail, more are looked for, so only ``max_nodes`` ends the search before its time.
    """
    best = best_fit(counts, capacity)
    total = int((counts * np.arange(len(counts))).sum())
    bound = lower_bound(counts, capacity)
    nodes = 0
    while len(best) > bound and nodes < max_nodes:
        spare = (len(best) - 1) * capacity - total  # the waste that one bin fewer would have
        left, path, better = counts.copy(), [], None
        wasted, seen = 0, set()

        def options(limit: int, tried: set) -> tuple[list, bool]:
            """(bin, how many), the last one to be tried first."""
            largest = int(np.flatnonzero(left)[-1])
            room = capacity - largest
            left[largest] -= 1
            found, more = fillings(left, room, limit, room - (spare - wasted))
            left[largest] += 1
            most, fewer = [], []
            for f in found:
                if f in tried:
                    continue
                tried.add(f)
                own = (largest, *f)
                m = min(int(left[x]) // own.count(x) for x in set(own))
                if waste := room - sum(f):
                    m = min(m, (spare - wasted) // waste)
                most.append((own, m))
                while (m := m // 2) > 0:
                    fewer.append((own, m))
            return (most + fewer)[::-1], more

        while nodes < max_nodes:
            if not left.any():
                better = [list(x) for (x, m), *_ in path for _ in range(m)]
                break
            nodes += 1
            state = (hash(left.tobytes()), wasted)
            if state in seen:
                path.append([None, [], False, max_fillings, set()])
            else:
                seen.add(state)
                tried: set = set()
                path.append([None, *options(max_fillings, tried), max_fillings, tried])
            # take the next option; go back where none is left
            while path:
                here = path[-1]
                if here[0] is not None:
                    own, m = here[0]
                    for x in own:
                        left[x] += m
                    wasted -= m * (capacity - sum(own))
                    here[0] = None
                while not here[1] and here[2] and nodes < max_nodes:
                    here[3] *= 4
                    nodes += (here[3] // max_fillings) ** 2  # what longer lists cost beside the first
                    here[1], here[2] = options(here[3], here[4])
                if here[1]:
                    own, m = here[0] = here[1].pop()
                    for x in own:
                        left[x] -= m
                    wasted += m * (capacity - sum(own))
                    break
                path.pop()
            if not path:
                break
        if better is None:
            break
        best = better
    return best


def _pack(capacity: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [(c, "ascending") for c in ("length", "doc_id", "piece", "copy")]))
        counts = np.bincount(group.column("length").to_numpy(), minlength=capacity + 1)
        next_row = np.concatenate([[0], np.cumsum(counts)])[:-1].tolist()
        seq, off = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        for b, content in enumerate(bin_completion(counts, capacity)):
            at = 0
            for x in content:
                seq[next_row[x]], off[next_row[x]] = b, at
                next_row[x] += 1
                at += x
        out = group.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array((np.int64(key[0].as_py()) << np.int64(32)) + seq)).append_column("offset", pa.array(off))

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows.
    """
    made = stage(pieces(docs, tokenizer, capacity, end_id), "pieces")
    groups = rows_per_group(made.count(), group_rows)
    # rows of a group: dealt by their own number, so no key can make one group large
    dealt = made.withColumn("g", F.pmod(F.xxhash64("copy", "piece", "ids_crc32"), F.lit(groups)).cast("long"))
    return dealt.groupBy("g").applyInArrow(_pack(capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
