"""op10: n-gram Jaccard join with set-relation skipping.

A document's set holds its distinct 4-word shingles (64-bit hashes). Sets of equal content are one class. Two sets that reach the
similarity share a token among the first n - ceil(t n) + 1 of their tokens in any common order; here tokens that few documents hold come first,
by counts over all documents in a hashed table of fixed size. Each class enters its prefix in the token lists, with its size
and each token's position in the set.

Lists are not compared pair by pair.
(1) In each list every set is compared with the list's first set only, where sizes and positions allow it; of these candidates a set takes
the one that shares most tokens. Sets found similar, directly or over others, are from then on one relation (a connected
component) and are skipped in each other's lists.
(2) Lists that still hold several relations are read in blocks of bounded size. Sizes, positions and the number of such lists that a set is in bound
what two sets can share; pairs of entries that cannot reach the similarity are skipped, and so are pairs of relations that meet in fewer lists than any of their
pairs needs. Of what is left, one member of each relation, its leader, is compared with the other's leader: their exact answer.
(3) The answers of the other members are derived from their leaders' answers. Jaccard distance is a metric, so members x, z of relations
with leaders a, b can be similar only if d(x, a) + d(z, b) + 1 - t >= d(a, b); only those that may be are looked up in
their common lists, counted as before and compared.
No link between different relations is left out, so the components are exact, while a group of thousands of near copies costs a
multiple of its size. Comparing reads whole texts again.

Lists of very frequent tokens are salted in (1) and cut into blocks in (2). Null and empty texts, and texts without words, have the
empty set and link with nothing. Repeated rows are members of one class. The component is the smallest doc_id; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap, components, discard, in_bitmap, materialise, mix64, powers, slices, table, tidied

SHINGLE, PERCENT = 4, 85
WIDTH, CHUNK = 1 << 21, 1 << 16
HOT = 4096
BLOCK = 512
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)]


#: ASCII letters are lower-cased; 32 and 9 to 13 are white space.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_VALUE = mix64(np.arange(1000, 1256, dtype=np.uint64))[_LOWER]
_PART = 1 << 20


def _word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of UTF-8 bytes, in order, without an object for each word."""
    out, at = [], 0
    while at < len(data):
        end = min(at + _PART, len(data))
        while end < len(data) and not _BLANK[data[end]]:  # parts end between words
            end += 1
        x = np.frombuffer(data, np.uint8, end - at, at)
        at = end
        blank = _BLANK[x]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
        first, last = edge[::2], edge[1::2]
        up, down = powers(len(x) + 1)
        c = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_VALUE[x] * up[: len(x)], out=c[1:])
        out.append(mix64((c[last] - c[first]) * down[first] + (last - first).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    w = _word_hashes((text or "").encode("utf-8", "replace"))
    if not len(w):
        return w
    k = min(size, len(w))
    s = np.full(len(w) - k + 1, np.uint64(k))
    for j in range(k):
        s = s * _M[5] + w[j : len(w) - k + 1 + j] * _M[j % 5]
    s = mix64(s)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def need(n: int, percent: int = PERCENT) -> int:
    """The least overlap that any similar set has with one of n tokens."""
    return -(-percent * n // 100)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def token_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each token, by its last bits: a table of fixed size, summed in chunks over all documents."""

    def run(batches):
        total = np.zeros(WIDTH, np.int64)
        for batch in batches:
            for b in slices(batch, 0):
                for t in b.column(0).to_pylist():
                    np.add.at(total, (shingles(t, size) & np.uint64(WIDTH - 1)).astype(np.int64), 1)
        rows = [(k, zlib.compress(total[k * CHUNK : (k + 1) * CHUNK].tobytes(), 1)) for k in range(WIDTH // CHUNK) if total[k * CHUNK : (k + 1) * CHUNK].any()]
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([part // 64] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "part", "data"])

    def add(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["data"])
        return pd.DataFrame({"chunk": [key[0]], "part": [0], "data": [zlib.compress(total.tobytes(), 1)]})

    kind = "chunk int, part int, data binary"
    sums = docs.select("text").mapInArrow(tidied(run), kind).groupBy("chunk", "part").applyInPandas(add, kind).groupBy("chunk").applyInPandas(add, kind)
    out = np.zeros(WIDTH, np.int64)
    for r in sums.collect():  # WIDTH counts in all, whatever the input
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.int64)
    return out


def _set_id(s: np.ndarray) -> int:
    x = int(np.bitwise_xor.reduce(mix64(s + np.uint64(1)))) ^ int(np.add.reduce(mix64(s ^ _M[0]))) * 3
    return int(np.array([(x + len(s)) & (2**64 - 1)], np.uint64).view(np.int64)[0])


def prefixes(docs: DataFrame, counts, size: int, percent: int) -> DataFrame:
    """(doc_id, n, set_id, rank, prefix array<bigint>, salts array<int>): tokens in common order, most telling first. rank is least for sets
    whose telling tokens are in many documents: such a set is near the middle of its group. counts: broadcast."""

    def run(batches):
        have = counts.value
        for b in (b for batch in batches for b in slices(batch, 1)):
            ids = b.column(0)
            n, sets, ranks, pre, salts = [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, size)
                n.append(len(s))
                if not len(s):
                    sets.append(0)
                    ranks.append(0)
                    pre.append([])
                    salts.append([])
                    continue
                sid = _set_id(s)
                sets.append(sid)
                f = have[(s & np.uint64(WIDTH - 1)).astype(np.int64)]
                level = np.log2(f + 1.0).astype(np.int64)
                k = np.lexsort((s, level))[: len(s) - need(len(s), percent) + 1]
                pre.append((s[k] >> np.uint64(16)).astype(np.int64))  # 48 bits: a clash only adds candidates
                ranks.append(-int(1000 * level[k].mean()))
                parts = 1 + f[k] // HOT
                salts.append(np.where(parts > 1, 1 + (sid & 0x7FFFFFFF) % parts, 0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array(sets, pa.int64()), pa.array(ranks, pa.int32()), pa.array(pre, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32()))], names=["doc_id", "n", "set_id", "rank", "prefix", "salts"])

    return docs.mapInArrow(tidied(run), "doc_id long, n int, set_id long, rank int, prefix array<bigint>, salts array<int>")


def _lists():
    """Streams lists (sorted by token, salt, rank, set_id): rows of lists of one set go, the others get their list's first set."""
    names = ["token", "x", "n", "pos", "hub", "hub_n", "hub_pos"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())

    def run(batches):
        head, single = None, None
        for b in batches:
            out: list[tuple] = []
            for token, salt, rank, sid, n, pos in zip(*(c.to_pylist() for c in b.columns)):
                if head is None or head[0] != token or head[1] != salt:
                    head, single = (token, salt, sid, n, pos), (token, sid, n, pos, sid, n, pos)
                    if salt:
                        out.append(single)
                        single = None
                elif sid != head[2]:
                    if single:
                        out.append(single)
                        single = None
                    out.append((token, sid, n, pos, *head[2:]))
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return tidied(run)


def _possible(n: str, m: str, i: str, j: str, percent: int) -> F.Column:
    """Whether sizes n, m and positions i, j of one token let two sets be similar: they share at most min(i, j) tokens before it
    and min(n - i, m - j) from it on."""
    most = F.least(i, j) + F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (F.col(n) + F.col(m)))


def _fewest(n, m, percent: int, least=np.minimum, greatest=np.maximum):
    """In how many lists two similar sets of these sizes meet at least. Of the set whose prefix ends first in the common order, every shared
    token up to there is in the other's prefix too; beyond it lie need(size) - 1 tokens at most."""
    return greatest(1, -(-percent * (n + m) // (100 + percent)) + (-percent * greatest(n, m) // 100) + 1)


def _meet(percent: int):
    """Streams blocks (sorted by token, lo, hi; rows token, lo, hi, b, n, pos, r, most, after): for each two relations that have a possible pair of
    entries in the block, (ra, rb, the least number of lists in which one of the pairs must be given). Two similar sets that must meet in f lists are
    given only where each has f // 2 of its lists still to come: that holds in all but the last f // 2 of the lists where they meet."""

    def pairs(own):
        b, n, i, r, most_of, after = (np.array(c, np.int64) for c in zip(*(x[3:] for x in own)))
        lo, hi = own[0][1], own[0][2]
        left, right = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        # blocks of entries of like size: a pair of blocks whose sizes cannot meet is skipped whole, then its pairs by position
        left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
        found = []
        for k in range(0, len(left), 64):
            x = left[k : k + 64]
            least, most = int(n[x[0]]), int(n[x[-1]])
            y = right[np.searchsorted(n[right], -(-percent * least // 100)) : np.searchsorted(n[right], 100 * most // percent, "right")]
            nx, ny, ix, iy = n[x][:, None], n[y][None, :], i[x][:, None], i[y][None, :]
            share = np.minimum(np.minimum(ix, iy) + np.minimum(nx - ix, ny - iy), np.maximum(most_of[x][:, None], most_of[y][None, :]))
            ok = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & ((100 + percent) * share >= percent * (nx + ny))
            ok &= (r[x][:, None] < r[y][None, :]) if lo == hi else (r[x][:, None] != r[y][None, :])
            p, q = np.nonzero(ok)
            p, q = x[p], y[q]
            fewest = _fewest(n[p], n[q], percent)
            early = np.minimum(after[p], after[q]) >= fewest // 2
            p, q, fewest = p[early], q[early], fewest[early]
            found.append(np.stack([np.minimum(r[p], r[q]), np.maximum(r[p], r[q]), fewest - fewest // 2]))
        f = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        f = f[:, np.lexsort(f[::-1])]
        first = np.ones(f.shape[1], bool)
        first[1:] = (f[:2, 1:] != f[:2, :-1]).any(0)
        return f[:, first]

    def two(own):
        (_, _, _, _, n, i, r, a, e), (_, _, _, _, m, j, q, b, f) = own
        share = min(min(i, j) + min(n - i, m - j), max(a, b))
        ok = r != q and 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * share >= percent * (n + m)
        fewest = _fewest(n, m, percent, min, max)
        return np.array([[min(r, q)], [max(r, q)], [fewest - fewest // 2]], np.int64) if ok and min(e, f) >= fewest // 2 else np.zeros((3, 0), np.int64)

    def run(batches):
        own: list[tuple] = []
        head = None
        for batch in batches:
            out = [np.zeros((3, 0), np.int64)]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != head:
                    if len(own) > 1:
                        out.append(two(own) if len(own) == 2 and own[0][1] == own[0][2] else pairs(own))
                    own, head = [], row[:3]
                own.append(row)
            f = np.concatenate(out, 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in f], names=["ra", "rb", "fewest"])
        f = (pairs(own) if len(own) > 1 else np.zeros((3, 0), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in f], names=["ra", "rb", "fewest"])

    return tidied(run)


def _texts(docs: DataFrame, own: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(set_id, packed text) of the classes in ids, one each: a bitmap of their smallest doc_ids drops most other documents unread."""
    spark = docs.sparkSession
    least = own.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    wanted = materialise(least.join(ids, "set_id"), "wanted")
    bits = spark.sparkContext.broadcast(bitmap(wanted.select(F.coalesce("doc_id", F.lit(0)))))

    def run(batches):
        have, codec = bits.value, pa.Codec("zstd", compression_level=1)
        for b in (b for batch in batches for b in slices(batch, 1)):
            sets, sizes, data = [], [], []
            hit = np.flatnonzero(in_bitmap(have, b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            for k in hit.tolist():
                t = b.column(1)[k].as_py()
                s = shingles(t, size)
                if len(s):
                    raw = t.encode("utf-8", "replace")
                    sets.append(_set_id(s))
                    sizes.append(len(raw))
                    data.append(codec.compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["set_id", "size", "data"])

    found = docs.mapInArrow(tidied(run), "set_id long, size int, data binary").join(wanted.select("set_id"), "set_id", "left_semi")
    return found.select("set_id", F.struct("size", "data").alias("text")).dropDuplicates(["set_id"])


def compare(pairs: DataFrame, docs: DataFrame, own: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (u, v) of classes with their distance and whether they are similar. A task keeps sets that it met, up to a bound."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        total = 0
        codec = pa.Codec("zstd", compression_level=1)

        def of(i: int, text) -> np.ndarray:
            nonlocal total
            s = kept.get(i)
            if s is None:
                if total > 2_000_000:  # 16 MB
                    kept.clear()
                    total = 0
                x = text.as_py()
                s = kept[i] = shingles(codec.decompress(x["data"], x["size"], asbytes=True).decode(), size)
                total += len(s)
            return s

        for b in batches:
            u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            far, near = [], []
            for i, j, a, c in zip(u, v, b.column(2), b.column(3)):
                x, y = of(i, a), of(j, c)
                both = overlap(x, y)
                every = len(x) + len(y) - both
                far.append(1.0 - both / every)
                near.append(both > 0 and 100 * both >= percent * every)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far, pa.float64()), pa.array(near, pa.bool_())], names=["u", "v", "d", "near"])

    texts = materialise(_texts(docs, own, pairs.select(F.col("u").alias("set_id")).union(pairs.select("v")).distinct(), size), "texts")
    both = pairs.join(texts.select(F.col("set_id").alias("u"), F.col("text").alias("tu")), "u")
    both = both.join(texts.select(F.col("set_id").alias("v"), F.col("text").alias("tv")), "v")
    out = materialise(both.select("u", "v", "tu", "tv").mapInArrow(tidied(run), "u long, v long, d double, near boolean"), "compared")
    discard(texts)
    return out


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(ra, block, own): the rows (ra, x, n, far, d, tokens) of each relation in blocks of about so many."""
    cuts = rows.groupBy("ra").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("cuts"))
    dealt = rows.join(cuts, "ra").withColumn("block", F.pmod(F.xxhash64("x", "d"), F.col("cuts")).cast("int"))
    return dealt.groupBy("ra", "block").agg(F.collect_list(F.struct("x", "n", "far", "d", "tokens")).alias("own"))


def _shared(percent: int):
    """Pairs of blocks: the pairs of sets that distances and sizes leave possible and that meet in enough lists. Lists in common are counted by a
    product of the blocks' incidence matrices."""
    free = 1 - percent / 100 + 1e-9

    def load(own):
        tokens = [x["tokens"] for x in own]
        row = np.repeat(np.arange(len(own)), [len(t) for t in tokens])
        return [np.array([x[k] for x in own]) for k in ("x", "n", "far", "d")], np.array([y for t in tokens for y in t], np.int64), row

    def run(batches):
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(batch.num_rows):
                (xa, na, fa, _), ta, ia = load(batch.column(0)[k].as_py())
                (xb, nb, fb, d), tb, ib = load(batch.column(1)[k].as_py())
                common = np.intersect1d(ta, tb)
                count = np.zeros((len(xa), len(xb)), np.float32)
                for at in range(0, len(common), 2048):
                    part = common[at : at + 2048]
                    both = []
                    for t, i, m in ((ta, ia, len(xa)), (tb, ib, len(xb))):
                        j = np.minimum(np.searchsorted(part, t), len(part) - 1)
                        hit = part[j] == t
                        one = np.zeros((m, len(part)), np.float32)
                        one[i[hit], j[hit]] = 1
                        both.append(one)
                    count += both[0] @ both[1].T
                n, m = na[:, None], nb[None, :]
                ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (fa[:, None] + fb[None, :] + free >= d[None, :])
                i, j = np.nonzero(ok & (count >= _fewest(n, m, percent)))
                us.append(xa[i])
                vs.append(xb[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (us, vs)], names=["u", "v"])

    return tidied(run)


def _derived(open_pairs: DataFrame, known: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(3) the pairs (u, v) of members of open pairs of relations (ra, rb, d) that their leaders' answers leave possible and that meet often enough.
    members: (x, r, far), far the distance from the leader. The members of a relation, and those of all relations that are open
    with it, meet in blocks of bounded size."""
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    free = 1 - percent / 100 + 1e-9
    size = members.groupBy("r").agg(F.count(F.lit(1)).alias("c"), F.max("far").alias("reach"))
    of = lambda side: size.select(F.col("r").alias(f"r{side}"), F.col("c").alias(f"c{side}"), F.col("reach").alias(f"reach_{side}"))
    both = open_pairs.join(of("a"), "ra").join(of("b"), "rb").where(F.col("reach_a") + F.col("reach_b") + free >= F.col("d"))
    turn = F.col("ca") < F.col("cb")
    pick = lambda x, y: F.when(turn, F.col(x)).otherwise(F.col(y))
    both = both.select(pick("rb", "ra").alias("ra"), pick("ra", "rb").alias("rb"), "d", pick("reach_b", "reach_a").alias("reach_a"), pick("reach_a", "reach_b").alias("reach_b"))
    own = known.join(members, ["x", "r"]).groupBy("x", "r").agg(F.first("n").alias("n"), F.first("far").alias("far"), F.collect_set("token").alias("tokens"))
    own, both = materialise(own, "members-lists"), materialise(both, "open-pairs")
    least = both.groupBy("ra").agg(F.min(F.col("d") - F.col("reach_b")).alias("least"))
    a = own.join(least, F.col("r") == F.col("ra")).where(F.col("far") + free >= F.col("least")).select("ra", "x", "n", "far", F.lit(0.0).alias("d"), "tokens")
    b = own.join(both, F.col("r") == F.col("rb")).where(F.col("far") + F.col("reach_a") + free >= F.col("d")).select("ra", "x", "n", "far", "d", "tokens")
    a = materialise(_blocks(a, BLOCK).select("ra", F.col("block").alias("i"), F.col("own").alias("left")), "blocks")
    b = materialise(_blocks(b, BLOCK).select("ra", F.col("block").alias("j"), F.col("own").alias("right")), "blocks")
    meet = a.select("ra", "i").join(b.select("ra", "j"), "ra").repartition(parts, "ra", "i", "j")
    found = meet.join(a, ["ra", "i"]).join(b, ["ra", "j"]).select("left", "right").mapInArrow(_shared(percent), "u long, v long")
    found = materialise(found.distinct(), "pairs")
    discard(own, a, b)
    return found


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(np.minimum(token_counts(docs, size), 2**31 - 1).astype(np.int32))
    own = materialise(prefixes(docs, counts, size, percent), "prefixes")
    counts.destroy()
    sets = own.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("rank").alias("rank"), F.first("prefix").alias("prefix"), F.first("salts").alias("salts"))
    entries = sets.select("set_id", "n", "rank", F.posexplode(F.arrays_zip("prefix", "salts")).alias("pos", "e"))
    entries = entries.select(F.col("e.prefix").alias("token"), F.col("e.salts").alias("salt"), "rank", "set_id", "n", "pos")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = entries.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "rank", "set_id").mapInArrow(_lists(), "token long, x long, n int, pos int, hub long, hub_n int, hub_pos int")
    lists = materialise(lists, "lists")

    # (1) each set against the first of a list, the one that shares most of its tokens
    shared = lists.where("x <> hub").where(_possible("n", "hub_n", "pos", "hub_pos", percent)).groupBy("x", "hub").agg(F.count(F.lit(1)).alias("k"))
    best = shared.groupBy("x").agg(F.max(F.struct("k", F.col("hub").alias("h"))).alias("b")).select(F.col("b.h").alias("u"), F.col("x").alias("v"))
    first = compare(materialise(best, "pairs"), docs, own, size, percent)
    links = first.where("near").select("u", "v")

    # (2) leaders of the relations that still meet
    relation = components(links).select(F.col("node").alias("x"), F.col("component").alias("c"))
    lead = links.join(relation, F.col("u") == F.col("x")).groupBy("c", "u").agg(F.count(F.lit(1)).alias("k")).groupBy("c").agg(F.max(F.struct("k", "u")).alias("most"))
    relation = materialise(relation.join(lead, "c").select("x", F.col("most.u").alias("r")), "relations")  # named after its leader, the most linked member
    known = lists.select("token", "x", "n", "pos").join(relation, "x", "left").withColumn("r", F.coalesce("r", "x"))
    known = materialise(known, "related-lists")
    mixed = known.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("r").alias("r0"), F.max("r").alias("r1")).where("r0 <> r1")
    mixed = mixed.select("token", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    known, every = materialise(known.join(mixed, "token"), "mixed-lists"), known  # lists of one relation are done
    discard(every, lists)
    # of two sets, one's prefix ends first; it shares with the other's relation its tokens in these lists and those behind its prefix at most
    w = Window.partitionBy("x")
    block = known.withColumn("k", F.count(F.lit(1)).over(w)).withColumn("after", (F.col("k") - F.row_number().over(w.orderBy("pos"))).cast("int"))
    block = block.withColumn("most", (F.ceil(percent * F.col("n") / 100) - 1 + F.col("k")).cast("int"))
    block = block.withColumn("b", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    block = block.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = block.select("token", F.least("b", "j").alias("lo"), F.greatest("b", "j").alias("hi"), "b", "n", "pos", "r", "most", "after")
    meet = block.repartition(parts, "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(_meet(percent), "ra long, rb long, fewest long")
    meet = meet.groupBy("ra", "rb").agg(F.count(F.lit(1)).alias("k"), F.min("fewest").alias("fewest")).where("k >= fewest")
    size_of = relation.groupBy("r").agg(F.count(F.lit(1)).alias("members"))
    meet = meet.join(size_of.select(F.col("r").alias("ra"), F.col("members").alias("ma")), "ra", "left").join(size_of.select(F.col("r").alias("rb"), F.col("members").alias("mb")), "rb", "left")
    meet = materialise(meet.select("ra", "rb", (F.col("ma").isNotNull() | F.col("mb").isNotNull()).alias("open")), "relation-pairs")
    answers = compare(meet.select(F.col("ra").alias("u"), F.col("rb").alias("v")), docs, own, size, percent)
    links = links.union(answers.where("near").select("u", "v"))

    # (3) members of relations whose leaders are not similar
    joined = components(links).select(F.col("node"), "component")
    left = meet.where("open").join(answers.where("not near").select(F.col("u").alias("ra"), F.col("v").alias("rb"), "d"), ["ra", "rb"])
    left = left.join(joined.select(F.col("node").alias("ra"), F.col("component").alias("ca")), "ra", "left").join(joined.select(F.col("node").alias("rb"), F.col("component").alias("cb")), "rb", "left")
    left = materialise(left.where("not (ca <=> cb) or ca is null").select("ra", "rb", "d"), "open-pairs")
    if not left.isEmpty():
        some = left.select(F.col("ra").alias("r")).union(left.select("rb")).distinct()
        others = relation.join(some, "r").where("x <> r")
        far = compare(others.select(F.col("r").alias("u"), F.col("x").alias("v")), docs, own, size, percent)
        members = far.select(F.col("v").alias("x"), F.col("u").alias("r"), F.col("d").alias("far")).union(some.select(F.col("r").alias("x"), "r", F.lit(0.0).alias("far")))
        more = _derived(left, known.select("token", "x", "n", "r"), materialise(members, "members"), percent)
        links = links.union(compare(more, docs, own, size, percent).where("near").select("u", "v"))
        joined = components(links)
    to = own.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set_id")
    named = to.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    each = named.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "least", F.coalesce("component", "set_id").alias("component"))
    top = each.groupBy("component").agg(F.min("least").alias("component_id"))
    final = materialise(each.join(top, "component").select("set_id", "component_id"), "classes")
    discard(known, meet)
    return to.join(final, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
