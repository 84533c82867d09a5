"""op7: best-fit packing by bin completion.

Every document (null text: empty) becomes its token ids and the end id; one longer than a sequence is cut into full pieces, the
first of them shorter. Which pieces share a sequence depends on their lengths alone, so the search runs over the counts of the
at most ``size`` lengths, however many documents there are: best fit decreasing gives an incumbent; then branch and bound
fills the sequence of the largest piece left, over undominated completions in order of waste, pruned where the sequences used
and the least number for the rest reach the incumbent. A completion is used as often as its counts allow, so that each step
empties a length and a solution has at most ``size`` patterns. What bounds the search is stated at complete_bins(). Pieces of equal length are
alike: they take their places by their rank among equal lengths,
which is dealt out over buckets of rows. Repeated rows are documents of their own; an empty table gives no rows; other columns are
dropped.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slices, table, tidied
from .tokens import coder

Pattern = tuple[tuple[int, ...], int]


def best_fit(counts: np.ndarray, size: int) -> list[Pattern]:
    """Best fit decreasing over counts of lengths: as pieces one by one, in batches of equal sequences."""
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    rooms: list[int] = []
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):  # as many as fit go into each new sequence
                per = size // length
                for each, times in ((per, n // per), (n % per, 1)):
                    if each and times:
                        room = size - each * length
                        by_room[room][(length,) * each] += times
                        if room not in rooms:
                            bisect.insort(rooms, room)
                break
            room = rooms[k]
            own, have = next(iter(by_room[room].items()))
            each = min(room // length, n)
            times = min(have, n // each)
            if have == times:
                del by_room[room][own]
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(k)
            else:
                by_room[room][own] = have - times
            left = room - each * length
            by_room[left][own + (length,) * each] += times
            if left not in rooms:
                bisect.insort(rooms, left)
            n -= each * times
    return [(p, n) for own in by_room.values() for p, n in own.items()]


def least_bins(counts: np.ndarray, size: int) -> int:
    """A lower bound: the space bound and, over thresholds, pieces too large to meet (Martello and Toth's L2)."""
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    best = -(-total // size)
    many = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    space = np.concatenate([np.cumsum((counts * lengths)[::-1])[::-1], [0]])
    for a in {1, size // 8, size // 4, size // 3, size // 2} - {0}:
        large = int(many[size - a + 1]) if size - a + 1 <= size else 0
        half_n = int(many[size // 2 + 1]) - large
        half_s = int(space[size // 2 + 1]) - int(space[min(size - a + 1, size + 1)])
        small = int(space[a]) - int(space[size // 2 + 1])
        best = max(best, large + half_n + max(0, -(-(small - (half_n * size - half_s)) // size)))
    return best


def undominated(own: tuple[int, ...], waste: int, free: np.ndarray) -> bool:
    """Whether no free piece fits into the waste or, in place of up to three pieces of the filling, holds at least what they hold (Martello and
    Toth's dominance). free: ascending sizes of which a piece is left."""

    def any_in(low: int, high: int) -> bool:
        k = bisect.bisect_left(free, low)
        return k < len(free) and free[k] <= high

    if any_in(1, waste):
        return False
    for n in (1, 2, 3):
        for some in set(itertools.combinations(own, n)):
            total = sum(some)
            if any_in(total + (n == 1), total + waste):
                return False
    return True


def completions(counts: np.ndarray, room: int, width: int | None, nodes: int | None = 400) -> list[tuple[int, ...]]:
    """Undominated fillings of the room from the counts, least waste first, larger pieces first among equals; at most width of them. Of
    all ways to end a filling with one more piece only the largest that fits is undominated, so the walk branches on the pieces
    before the last alone. nodes bounds it (None: all fillings); the first way down is best fit, so there is always one."""
    sizes = np.flatnonzero(counts[: room + 1])
    sizes = sizes[sizes > 0].tolist()
    found: dict[tuple[int, ...], int] = {}
    left = [nodes if nodes is not None else -1]
    perfect = [0]

    def largest(limit: int, own: tuple[int, ...]) -> int:
        k = bisect.bisect_right(sizes, limit) - 1
        while k >= 0 and counts[sizes[k]] <= own.count(sizes[k]):
            k -= 1
        return k

    def walk(top: int, room: int, own: tuple[int, ...]) -> None:
        if not left[0] or width is not None and perfect[0] >= width:
            return
        left[0] -= 1
        k = largest(min(room, top), own)
        if k < 0:
            if own not in found:
                free = [s for s in sizes if counts[s] > own.count(s)]
                if undominated(own, room, free):
                    found[own] = room
                    perfect[0] += room == 0
            return
        walk(sizes[k], room - sizes[k], (*own, sizes[k]))
        for j in range(min(k, bisect.bisect_right(sizes, room - sizes[0])) - 1, -1, -1):
            s = sizes[j]
            if not left[0]:
                break
            if counts[s] > own.count(s) and largest(min(room - s, s), (*own, s)) >= 0:
                walk(s, room - s, (*own, s))

    walk(room, room, ())
    if not found:  # the walk ended early on dominated fillings
        own, rest = (), room
        while (k := largest(rest, own)) >= 0:
            own, rest = (*own, sizes[k]), rest - sizes[k]
        found[own] = rest
    return sorted(found, key=lambda p: (found[p], [-x for x in p]))[:width]


def complete_bins(counts, size: int, width: int | None = 3, nodes: int | None = 6000, effort: int | None = 400, depth: int | None = 200) -> list[Pattern]:
    """Patterns (lengths, times) that hold counts[length] pieces of each length, in as few sequences as the search finds.

    The search is bounded by documented parameters: width fillings a step (one where the stack holds depth or more), effort nodes for the
    fillings of a step, nodes steps in all. Whatever they are, every piece has a place and the result is no worse than best fit. With
    None for all four the search is exhaustive over undominated fillings, used one at a time, and the result is optimal."""
    counts = np.asarray(counts, dtype=np.int64)
    full = int(counts[size])
    counts = counts.copy()
    counts[size] = 0
    incumbent = best_fit(counts, size)
    most, goal = sum(n for _, n in incumbent), least_bins(counts, size)
    left = -1 if nodes is None else nodes
    stack: list[tuple[np.ndarray, int, tuple | None]] = [(counts, 0, None)]
    while stack and left and most > goal:
        left -= 1
        now, used, chain = stack.pop()
        if used + least_bins(now, size) >= most:
            continue
        if not now.any():
            most, incumbent = used, []
            while chain:
                incumbent.append(chain[0])
                chain = chain[1]
            continue
        largest = int(np.flatnonzero(now)[-1])
        rest = now.copy()
        rest[largest] -= 1
        for filling in reversed(completions(rest, size - largest, width if depth is None or len(stack) < depth else 1, effort)):
            pattern = (largest, *filling)
            uses = defaultdict(int)
            for s in pattern:
                uses[s] += 1
            times = min(int(now[s]) // k for s, k in uses.items()) if width is not None else 1
            after = now.copy()
            for s, k in uses.items():
                after[s] -= times * k
            stack.append((after, used + times, ((pattern, times), chain)))
    return incumbent + ([((size,), full)] if full else [])


def places(patterns: list[Pattern], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, sequence ids of those ranks, offsets. Ranks from one first rank to the next have
    consecutive sequence ids."""
    own = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, times in patterns:
        at = 0
        for s in pattern:
            own[s].append((taken[s], base, at))
            taken[s] += times
            at += s
        base += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*v)) for s, v in own.items()}


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first shorter."""
    first = n % size or size
    ends = range(first, n + 1, size)
    return [(max(0, e - size), e - max(0, e - size)) for e in ends]


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        code, end = coder(tokenizer), int(end_id).to_bytes(4, "little")
        for b in (b for batch in batches for b in slices(batch, 1)):
            rows = []
            for i, ids in zip(b.column(0).to_pylist(), code.encode_all(b.column(1).to_pylist())):
                ids += end
                rows += [(i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, size))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """Packs documents (doc_id, text): pieces_of() with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = materialise(pieces_of(docs, tokenizer, end_id, size), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most size rows
        counts[r["length"]] = r["count"]
    at = places(complete_bins(counts, size), size)
    buckets = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    base = dealt.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    base = base.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rn", F.row_number().over(own)).join(base.select("bucket", "length", F.coalesce("before", F.lit(0)).alias("before")), ["bucket", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rn") - 1).alias("rank"))

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length):
                firsts, bases, offs = at[int(s)]
                m = np.flatnonzero(length == s)
                k = np.searchsorted(firsts, rank[m], "right") - 1
                seq[m], off[m] = bases[k] + rank[m] - firsts[k], offs[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
