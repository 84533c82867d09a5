"""op9: removal of repeated passages by an enhanced suffix array over content-chosen suffixes.

Every window of ``width`` bytes names the least hash among its grams (the leftmost among equals) as its anchor, so that equal
windows, wherever they are, have equal anchors at equal places, and all windows of a document fall into runs of one anchor
each, of less than 2 * width bytes. Windows can only repeat within runs of one anchor hash.

Runs of one content that occur twice are repeated whole, whatever their number: equal runs are found by counting their
64-bit content hashes. The different runs of an anchor form a group: their suffixes from the anchor are sorted, a stack scan over common
prefixes gives the interval tree, and in each interval the members' extensions to the left (all alike: not left-maximal, its
parent or another anchor reports it) tell the maximal repeats with all occurrences; those of ``width`` bytes or more are covered.

A group of more than ``group`` different runs is first divided by content over all tasks: windows that begin lo to hi bytes left of the anchor
share the bytes from lo left of it to width - hi right of it, so runs are dealt by that core; a part of one run drops out, a part of at most
``group`` runs goes to the interval tree, a part whose runs are alike over all bytes that its windows reach is one interval of
the tree with all its members and is done, and any other is dealt again by halves of lo to hi. A task thus never holds more than ``group``
runs, whatever the size of a group.

The same is done over words instead of bytes (units: bytes or words, as 64-bit hashes of what stands between white space): a passage of ``PASSAGE`` words
or more that occurs again, whatever white space lies between its words, is repeated however few bytes it has.

Null texts count as empty. Matches never cross documents; repeated rows are other occurrences; overlapping occurrences count. Two different grams
or windows are taken for equal only if 64-bit hashes clash. Other columns are ignored in spans(), kept in remove(). Text is UTF-8
bytes; in texts a character that is cut in part goes whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, discard, in_bitmap, materialise, mix64, powers, slices, table, tidied

WIDTH, GRAM, GROUP = 400, 32, 1024
PASSAGE, WORD_GRAM = 51, 8
STEP = 1 << 19
_MASK = np.uint64((1 << 20) - 1)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_FAR = 1 << 30
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words [^\\x20\\x09-\\x0D]+ begin and end."""
    edge = np.diff(np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word, from prefix sums over stretches of about STEP bytes."""
    start, stop = word_bounds(data)
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + STEP)))
        x = np.frombuffer(data, np.uint8, stop[j - 1] - start[i], start[i])
        up, down = powers(len(x) + 1)
        c = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTES[x] * up[: len(x)], out=c[1:])
        a, b = start[i:j] - start[i], stop[i:j] - start[i]
        out[i:j] = mix64((c[b] - c[a]) * down[a] + (b - a).astype(np.uint64) * _BYTES[7])
        i = j
    return out


class Units(NamedTuple):
    """What a text is a sequence of: how many bytes a unit takes in a segment, the units of a gram, the text's units."""

    size: int
    gram: int
    of: Callable[[bytes], bytes | np.ndarray]


BYTES = Units(1, GRAM, bytes)
WORDS = Units(8, WORD_GRAM, word_hashes)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    size = -(-len(x) // w) * w
    pad = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(x)] = x
    rows = pad.reshape(-1, w)
    first = np.minimum.accumulate(rows, axis=1).ravel()
    last = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(last[:n], first[w - 1 : w - 1 + n])


def runs(data: bytes | np.ndarray, width: int = WIDTH, gram: int = GRAM) -> list[np.ndarray]:
    """(anchor hash, content hash, anchor place, first window, last window) of all runs, as arrays."""
    out = []
    for base in range(0, max(0, len(data) - width + 1), STEP):
        x = data[base : base + STEP + width - 1]
        x = x if isinstance(x, np.ndarray) else _BYTES[np.frombuffer(x, np.uint8)]
        n = len(x)
        up, down = powers(n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(x * up[:n], out=c[1:])
        h = mix64((c[gram:] - c[:-gram]) * down[: n - gram + 1])
        key = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(key, width - gram + 1) & _MASK).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        p = at[first]
        content = mix64((c[last + width] - c[first]) * down[first] + (last - first).astype(np.uint64) * _BYTES[7] + (p - first).astype(np.uint64) * _BYTES[9])
        out.append((h[p], content, p + base, first + base, last + base))
    if not out:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
    return [np.concatenate(x) for x in zip(*out)]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def maximal_repeats(lefts: list[bytes], rights: list[bytes], width: int, size: int = 1) -> list[tuple[int, list[tuple[int, int]]]]:
    """The interval tree of suffixes that begin at an anchor. lefts: what precedes each, reversed; both in units of size bytes.
    Returns (common prefix, [(member, its longest left extension with another member)]) of intervals in which
    prefix and extension reach the width."""
    n = len(rights)
    order = sorted(range(n), key=lambda i: rights[i])
    lcp = [0] + [_common(rights[order[i - 1]], rights[order[i]]) // size for i in range(1, n)]
    by_left = sorted(range(n), key=lambda i: lefts[i])
    rank = [0] * n
    for k, i in enumerate(by_left):
        rank[i] = k
    ext = [0] + [_common(lefts[by_left[k - 1]], lefts[by_left[k]]) // size for k in range(1, n)]
    longest = max((len(x) // size for x in lefts), default=0)
    out = []

    def visit(depth: int, lo: int, hi: int) -> None:
        if depth + longest < width:
            return
        own = sorted(rank[order[i]] for i in range(lo, hi))
        near = []
        for a, b in zip(own, own[1:]):
            near.append(min(ext[a + 1 : b + 1]))
        best = [max(near[i - 1] if i else -1, near[i] if i < len(near) else -1) for i in range(len(own))]
        found = [(by_left[r], e) for r, e in zip(own, best) if e >= 0 and depth + e >= width]
        if found:
            out.append((depth, found))

    stack: list[tuple[int, int]] = [(0, 0)]
    for i in range(1, n + 1):
        here = lcp[i] if i < n else -1
        lo = i - 1
        while stack and stack[-1][0] > here:
            depth, lo = stack.pop()
            visit(depth, lo, i)
        if i < n and (not stack or stack[-1][0] < here):
            stack.append((here, lo))
    return out


def extents(lefts: list[bytes], rights: list[bytes], width: int, size: int = 1) -> dict[int, tuple[int, int]]:
    """How far to the left and to the right of its anchor each member of a group is repeated: all its repeats hold the
    anchor, so together they are one stretch."""
    out: dict[int, tuple[int, int]] = {}
    for depth, members in maximal_repeats(lefts, rights, width, size):
        for i, left in members:
            a, b = out.get(i, (0, 0))
            out[i] = (max(a, left), max(b, depth))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _text_key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _count(width: int, units: Units):
    """Anchor and content hashes of all runs of all texts, with their number in a slice of the texts."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, 0):
                own = [runs(units.of(_bytes(t)), width, units.gram)[:2] for t in b.column(0).to_pylist() if t]
                a, r = (np.concatenate([x[k] for x in own]) if own else np.zeros(0, np.uint64) for k in (0, 1))
                _, at, c = np.unique(_pair(a, r), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(a[at]), _signed(r[at]), pa.array(c)], names=["a", "r", "c"])

    return tidied(run)


def _pair(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    return a ^ (r << np.uint64(1))


def _joined(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in order of their starts, those that meet as one."""
    if not len(start):
        return start, stop
    reach = np.maximum.accumulate(stop)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[first], reach[np.concatenate([first[1:], [len(start)]]) - 1]


def _collect(width: int, want, units: Units):
    """The runs with repeated anchors, once for each text that the task remembers; of runs with rivals also their bytes, if
    the task has not just given them. A run that a text holds several times is repeated whole: its stretches are given joined, without an
    anchor, and the run itself once. want: broadcast bitmaps of repeated anchors and of runs with rivals."""

    def run(batches):
        repeated, several = want.value
        texts: set[int] = set()
        given = np.zeros(1 << 18, np.uint64)  # one remembered run for each slot
        for batch in batches:
            for b in slices(batch, 0):
                cols: list[list[np.ndarray]] = [[] for _ in range(6)]
                sure: list[list[np.ndarray]] = [[] for _ in range(3)]
                segs: list[bytes | None] = []
                for t in b.column(0).to_pylist():
                    if not t:
                        continue
                    data = _bytes(t)
                    key = _text_key(data)
                    if key in texts:
                        continue
                    if len(texts) >= 100_000:
                        texts.clear()
                    texts.add(key)
                    data = units.of(data)
                    own = runs(data, width, units.gram)
                    keep = np.flatnonzero(in_bitmap(repeated, own[0]))
                    if not len(keep):
                        continue
                    a, r, p, s, e = (x[keep] for x in own)
                    both = _pair(a, r)
                    _, once, back, times = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
                    if len(once) < len(both):
                        again = times[back] > 1
                        start, stop = _joined(s[again], e[again] + width)
                        for c, x in zip(sure, (np.full(len(start), key, np.int64), start, stop)):
                            c.append(x)
                        a, r, p, s, e, both = (x[np.sort(once)] for x in (a, r, p, s, e, both))
                    slot = (mix64(both) >> np.uint64(46)).astype(np.int64)
                    send = in_bitmap(several, both) & (given[slot] != both)
                    given[slot[send]] = both[send]
                    for c, x in zip(cols, (a, r, np.full(len(a), key, np.int64), p, s, e)):
                        c.append(x)
                    segs += [bytes(data[i : j + width]) if m else None for i, j, m in zip(s.tolist(), e.tolist(), send.tolist())]
                if segs:
                    a, r, key, p, s, e = (np.concatenate(c) for c in cols)
                    yield pa.RecordBatch.from_arrays([_signed(a), _signed(r), pa.array(key), *(pa.array(x.astype(np.int32)) for x in (p, s, e)), pa.array(segs, pa.binary())], names=["a", "r", "text_key", "p", "s", "e", "seg"])
                if sure[0]:
                    key, start, stop = (np.concatenate(c) for c in sure)
                    start, stop, none = pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.nulls(len(key), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(key), start, start, stop, pa.nulls(len(key), pa.binary())], names=["a", "r", "text_key", "p", "s", "e", "seg"])

    return tidied(run)


def _solve(width: int, size: int):
    """Rows (k, a, r, off, seg) sorted by k: the extents of each group's members."""

    def batch_of(rows):
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["a", "r", "left", "right"])

    def run(batches):
        own: list[tuple] = []
        head = None

        def flush():
            lefts = [np.frombuffer(seg[: off * size], f"V{size}")[::-1].tobytes() for _, _, off, seg in own]
            found = extents(lefts, [seg[off * size :] for _, _, off, seg in own], width, size) if len(own) > 1 else {}
            rows = [(own[i][0], own[i][1], left, right) for i, (left, right) in found.items()]
            own.clear()
            return rows

        for batch in batches:
            for b in slices(batch, 4):
                out = []
                for k, a, r, off, seg in zip(*(c.to_pylist() for c in b.columns)):
                    if k != head:
                        out += flush()
                        head = k
                    own.append((a, r, off, seg))
                yield batch_of(out)
        yield batch_of(flush())

    return tidied(run)


def _near(segs: DataFrame, width: int, group: int, units: Units) -> DataFrame:
    """(a, r, left, right): how far the different runs of an anchor repeat one another. segs: a, r, off, seg, kinds."""
    spark = segs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "a long, r long, left int, right int"
    size = units.size
    length = (F.length("seg") / F.lit(size)).cast("int")

    def part(start, n):
        return F.substring("seg", start * F.lit(size) + 1, n * F.lit(size))

    def trees(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "k").sortWithinPartitions("k").mapInArrow(_solve(width, size), kind)

    out = trees(segs.where(F.col("kinds") <= group).select(F.col("a").alias("k"), "a", "r", "off", "seg"))
    rows = segs.where(F.col("kinds") > group).select("a", "r", "off", "seg", F.lit(0).alias("lo"), F.lit(width - units.gram).alias("hi"))
    before: list[DataFrame] = []
    while not rows.isEmpty():  # lo to hi halves each time: at most log2(width) + 1 rounds
        core = part(F.col("off") - F.col("lo"), F.col("lo") + F.lit(width) - F.col("hi"))
        reach = part(F.col("off") - F.col("hi"), F.col("hi") + F.lit(width) - F.col("lo"))
        whole = (F.col("off") >= F.col("hi")) & (length - F.col("off") >= F.lit(width) - F.col("lo"))
        rows = rows.withColumn("k", F.xxhash64("a", "lo", "hi", core)).withColumn("full", F.when(whole, F.xxhash64(reach)))
        alike = (F.count("full") == F.count(F.lit(1))) & (F.min("full") == F.max("full"))
        parts_of = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.coalesce(alike, F.lit(False)).alias("alike")).where("n > 1")
        dealt = materialise(rows.join(parts_of, "k").drop("full"), "group-parts")
        before.append(dealt)
        done = dealt.where("alike").select("a", "r", F.col("hi").alias("left"), (F.lit(width) - F.col("lo")).alias("right"))
        out = out.union(done).union(trees(dealt.where((F.col("n") <= group) & ~F.col("alike")).select("k", "a", "r", "off", "seg")))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
        rows = dealt.where((F.col("n") > group) & ~F.col("alike")).select("a", "r", "off", "seg", F.explode(halves).alias("h")).select("a", "r", "off", "seg", "h.lo", "h.hi")
        rows = rows.where((F.col("lo") <= F.col("off")) & (F.col("hi") >= F.col("off") + F.lit(width) - length))
    out = materialise(out.groupBy("a", "r").agg(F.max("left").alias("left"), F.max("right").alias("right")), "extents")
    discard(*before)
    return out


def covered(docs: DataFrame, width: int = WIDTH, group: int = GROUP, units: Units = BYTES) -> DataFrame:
    """(text_key, spans array<struct<start,stop>>): the repeated bytes (words) of each different text that has any."""
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"))
    every = docs.mapInArrow(_count(width, units), "a long, r long, c long").groupBy("a", "r").agg(F.sum("c").alias("c"))
    every = materialise(every, "runs")
    anchors = every.groupBy("a").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    known = materialise(every.join(anchors, "a").select("a", "r", "c", "kinds"), "repeated")
    discard(every)
    rivals = known.where("kinds > 1").select(F.col("a").bitwiseXOR(F.shiftleft("r", 1)).alias("k"))
    want = spark.sparkContext.broadcast((bitmap(known.select("a").distinct()), bitmap(rivals)))
    found = docs.mapInArrow(_collect(width, want, units), "a long, r long, text_key long, p int, s int, e int, seg binary")
    found = materialise(found, "occurrences")
    want.destroy()
    segs = found.where("seg is not null").select("a", "r", (F.col("p") - F.col("s")).alias("off"), "seg")
    segs = segs.groupBy("a", "r").agg(F.first("off").alias("off"), F.first("seg").alias("seg"))
    segs = materialise(segs.join(known.where("kinds > 1").select("a", "r", "kinds"), ["a", "r"]), "segments")
    near = _near(segs, width, group, units)
    discard(segs)
    whole = known.where("c > 1").select("a", "r", F.lit(_FAR).alias("left"), F.lit(_FAR).alias("right"))
    reach = whole.union(near).groupBy("a", "r").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    sure = found.where("a is null").select("text_key", F.col("s").alias("start"), F.col("e").alias("stop"))
    own = found.drop("seg").join(reach, ["a", "r"])
    start, stop = F.col("p") - F.least(F.col("left"), F.col("p") - F.col("s")), F.col("p") + F.least(F.col("right"), F.col("e") + width - F.col("p"))
    own = own.select("text_key", start.alias("start"), stop.alias("stop")).union(sure)
    own = own.groupBy("text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    own = materialise(own, "covered")
    discard(known, found, near)
    return own


def merge_spans(spans, n: int) -> list[tuple[int, int]]:
    return joined((max(0, x["start"]), min(n, x["stop"])) for x in spans or [])


def joined(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif e > s:
            out.append([s, e])
    return [tuple(x) for x in out]


def passages(raw: bytes, spans) -> list[tuple[int, int]]:
    """The bytes of spans of words, from the first word's start to the last one's end."""
    if not spans:
        return []
    start, stop = word_bounds(raw)
    return [(int(start[s]), int(stop[e - 1])) for s, e in merge_spans(spans, len(start))]


def kept_parts(raw: bytes, own: list[tuple[int, int]]) -> list[bytes]:
    """What is left of the bytes without the spans, in order."""
    edges = [0, *(y for s in own for y in s), len(raw)]
    return [raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]


def _cut(docs: DataFrame, width: int, group: int, words: int, make, kinds: str) -> DataFrame:
    """Joins each row to its text's spans and gives make(batch without text, bytes of texts, spans of texts, passages of texts). Texts
    travel compressed; only where a text is null stays with the row."""
    cover = covered(docs, width, group)
    said = covered(docs, words, group, WORDS)
    names = docs.columns
    k = names.index("text")
    rest = [n for n in names if n != "text"]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    sent = ", ".join([*(f"`{n}` {fields[n]}" for n in rest), "__key long", "__size int", "__data binary"])

    def key(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for b in slices(batch, k):
                data = [None if t is None else _bytes(t) for t in b.column(k).to_pylist()]
                keys = pa.array([_text_key(x or b"") for x in data], pa.int64())
                size = pa.array([0 if x is None else len(x) for x in data], pa.int32())
                packed = pa.array([None if x is None else codec.compress(x, asbytes=True) for x in data], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != k), keys, size, packed], names=[*rest, "__key", "__size", "__data"])

    def cut(batches):
        codec = pa.Codec("zstd", compression_level=1)
        m = len(rest)
        for batch in batches:
            for b in slices(batch, m + 1, 1_000_000):
                raw = [None if x is None else codec.decompress(x, n, asbytes=True) for n, x in zip(b.column(m).to_pylist(), b.column(m + 1).to_pylist())]
                own = [merge_spans(x, len(t or b"")) for x, t in zip(b.column(m + 2).to_pylist(), raw)]
                said = [passages(t or b"", x) for x, t in zip(b.column(m + 3).to_pylist(), raw)]
                yield make(b.columns[:m], raw, own, said)

    keyed = docs.mapInArrow(tidied(key), sent)
    both = keyed.join(cover.select(F.col("text_key").alias("__key"), F.col("spans").alias("__spans")), "__key", "left")
    both = both.join(said.select(F.col("text_key").alias("__key"), F.col("spans").alias("__passages")), "__key", "left")
    return both.select(*rest, "__size", "__data", "__spans", "__passages").mapInArrow(tidied(cut), kinds)


def spans(docs: DataFrame, width: int = WIDTH, group: int = GROUP, words: int = PASSAGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_chars, text, n_passages, passages) for each row of docs (doc_id, text): bytes of the text, bytes and
    maximal runs removed, hash of the bytes that stay, and these as a text with its number of code points; then the maximal passages made of
    repeated ones of that many words, start:end in bytes of the whole text, comma-joined. Passages of fewer bytes than width are only named, not removed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def make(cols, raw, own, said):
        raw = [t or b"" for t in raw]
        parts = [kept_parts(t, x) for t, x in zip(raw, own)]
        kept = ["".join(p.decode("utf-8", "ignore") for p in x) for x in parts]
        sha = [hashlib.sha256(b"".join(x)).hexdigest() for x in parts]
        named = [",".join(f"{s}:{e}" for s, e in x) for x in said]
        n = [[len(t) for t in raw], [sum(e - s for s, e in x) for x in own], [len(x) for x in own]]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array([len(t) for t in kept], pa.int64()), pa.array(kept, pa.string()), pa.array([len(x) for x in said], pa.int64()), pa.array(named, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_chars", "text", "n_passages", "passages"])

    return _cut(docs, width, group, words, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_chars long, text string, n_passages long, passages string")


def remove(docs: DataFrame, width: int = WIDTH, group: int = GROUP, words: int = PASSAGE) -> DataFrame:
    """docs with repeated passages of width bytes or of that many words taken out of text; all rows and columns stay. Characters cut in part go whole."""
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    k = names.index("text")

    def make(cols, raw, own, said):
        own = [joined(x + y) for x, y in zip(own, said)]
        kept = [None if t is None else "".join(p.decode("utf-8", "ignore") for p in kept_parts(t, x)) for t, x in zip(raw, own)]
        return pa.RecordBatch.from_arrays([*cols[:k], pa.array(kept, pa.string()), *cols[k:]], names=names)

    return _cut(docs, width, group, words, make, kinds)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
