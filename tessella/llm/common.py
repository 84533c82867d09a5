"""Helpers of the training-data operators: reading, shared scratch tables, range buckets and connected components.

Scratch tables are Parquet in the folder that the session names in ``spark.checkpoint.dir``, which driver and executors
share; a lost executor rereads them. Operators discard those that their result no longer reads; the rest go when the Python
process ends, or at ``release(spark)``.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once in an application: the driver serves a zip file of it to all executors."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if sc.applicationId in _SHIPPED or not package.is_dir():
        return
    _SHIPPED.add(sc.applicationId)
    path = Path(tempfile.mkdtemp(prefix="tessella-code-")) / "tessella_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and all runs in one process (local tests), a fresh local one."""
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/tessella/{what}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, nothing is computed twice."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "scratch", None)
        own = next((x for x in _SCRATCH if x[1] == path), None)
        if own:
            _SCRATCH.remove(own)
            _delete(*own)


def release(spark: SparkSession | None = None) -> None:
    """Deletes scratch tables; results that read them must have been written by then."""
    while _SCRATCH:
        try:
            _delete(*_SCRATCH.pop())
        except Exception:  # the JVM may be gone at exit
            return


atexit.register(release)


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of the column (a larger row alone): what a worker holds stays bounded."""
    n = batch.num_rows
    if not n:
        return
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size + 64)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def tidy() -> None:
    """Gives memory that a task no longer holds back to the system: workers serve many tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable) -> Callable:
    """A mapInArrow function that tidies up at its end, unless it saw little."""

    def each(batches):
        seen = 0

        def counted():
            nonlocal seen
            for b in batches:
                seen += b.nbytes
                yield b

        yield from run(counted())
        if seen > 4_000_000:
            tidy()

    return each


def bitmap(ids: DataFrame, bits: int = 1 << 26) -> np.ndarray:
    """A bitmap of fixed size of the ids' hashes (one long column), put together from the parts' bitmaps. What it lets through is
    checked exactly later: where it fills up, work grows, results do not change."""
    step = bits // 64

    def run(batches):
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            h = mix64(b.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)
            np.bitwise_or.at(own, (h >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)))
        keep = [k for k in range(64) if own[k * step // 8 : (k + 1) * step // 8].any()]
        data = [zlib.compress(own[k * step // 8 : (k + 1) * step // 8].tobytes(), 1) for k in keep]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "data"])

    def join(key, pdf):
        import pandas as pd

        total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in pdf["data"]])
        return pd.DataFrame({"chunk": [key[0]], "data": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros(bits // 8, np.uint8)
    for r in ids.mapInArrow(run, "chunk int, data binary").groupBy("chunk").applyInPandas(join, "chunk int, data binary").collect():
        out[r["chunk"] * step // 8 : (r["chunk"] + 1) * step // 8] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.uint8)
    return out


def in_bitmap(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the hashes the bitmap holds; it may hold others too."""
    h = mix64(x) & np.uint64(len(bits) * 8 - 1)
    return (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1


def range_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 ascending cut points of a long column, by percentile_approx over all rows; n is bounded by the caller."""
    if n <= 1:
        return []
    q = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(F.col(column), [float(x) for x in q], 10 * n).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def bucket_of(column: str, bounds: list[int], fan: int = 32) -> F.Column:
    """How many of the bounds are <= the column (null: 0), by two small searches of literal arrays instead of one long one."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    firsts = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    c = F.col(column)
    k = F.size(F.filter(firsts, lambda b: b <= c))
    inner = F.size(F.filter(F.get(fine, k - 1), lambda b: b <= c))
    return F.when(c.isNull() | (k <= 0), F.lit(0)).otherwise((k - 1) * F.lit(fan) + inner).cast("int")


def _union_find(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = q = parent.get(p, p)
            x = q
        return x

    def flush():
        own = list(parent)
        to = [root(x) for x in own]
        keep = [(a, b) for a, b in zip(own, to) if a != b]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in keep], pa.int64()), pa.array([b for _, b in keep], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # bounded memory; what is left over joins in later rounds
            yield flush()
    yield flush()


#: Edges that one task joins: what two rounds of local joins leave, if it is no more than this.
ONE_TASK = 250_000


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of edges (u long, v long): one row (node, component) for each node, component its smallest node.

    Each task first joins its own edges (union-find in bounded memory), fewer tasks join what those leave: a forest. One of at most one_task edges
    is joined in one task; a larger one by large-star and small-star rounds, which meet in O(log^2 n) rounds, each written to the
    shared folder. A hub's edges are spread by partial minima and skew joins.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    few = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    e = e.mapInArrow(_union_find, "u long, v long").repartition(few).mapInArrow(_union_find, "u long, v long")
    e = materialise(e.distinct(), "links")
    if e.count() <= one_task:
        old, e = e, materialise(e.coalesce(1).mapInArrow(_union_find, "u long, v long"), "links")
        discard(old)
        rounds = 0
    before = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # (u, m) for each u comes from the row with v = m; the others give (v, m)
        old, e = e, materialise(small.where("u <> v").distinct(), "links")
        discard(old)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        if rounds:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for hashes of substrings from prefix sums."""
    if not _POW or len(_POW[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        up, down = np.full(size, _B), np.full(size, _INV)
        up[0] = down[0] = 1
        _POW[:] = [np.cumprod(up), np.cumprod(down)]
    return _POW[0], _POW[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 with good spread (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
