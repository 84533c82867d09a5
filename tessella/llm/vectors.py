"""op3: near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Vectors of one label and dimension whose cosine reaches the threshold are linked. Rows of one label and equal components are
one vector with a count. Spherical k-means, fitted on a bounded sample, gives each vector its home cell; it also visits every
lower cell b in which a partner could live: a partner of v with home b is at most the chord sqrt(2 - 2 t) away and
closer to b than to v's home a, so v (a - b) <= chord |a - b|. Every linked pair thus meets in exactly one cell, and no link is lost. Cells are dealt
into blocks of bounded size, and pairs of blocks are multiplied in double precision; a pair of blocks gives link counts and a
spanning forest, never its pairs. Components join the forests; the smallest vec_id of each is kept.

Vectors that are null, zero or hold null or non-finite components, and null labels, link with nothing. Repeated rows are
vectors of their own, linked with each other; with equal vec_ids they are one node. An empty table gives no rows; other columns are ignored.
``slack`` below the chord trades exactness for fewer visits where vectors form no clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialise, table

THRESHOLD, BLOCK, SAMPLE = 0.93, 1024, 8192


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return np.unique(c, axis=0)


def _clean(df: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vec binary): unit vectors of the rows that can link."""

    def run(batches):
        for b in batches:
            ids, labels, dims, vecs = [], [], [], []
            for i, v, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if v is None or y is None or i is None or not v or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                x = x / np.abs(x).max()
                ids.append(i)
                labels.append(y)
                dims.append(len(x))
                vecs.append((x / np.sqrt(x @ x)).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["vec_id", "label", "dim", "vec"])

    return df.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long")).mapInArrow(run, "vec_id long, label long, dim int, vec binary")


def _places(vectors: DataFrame, centroids: dict[int, np.ndarray], chord: float) -> DataFrame:
    """(label, dim, cell, home, rep, n, vec): each vector in its home cell and in the lower cells that it must visit."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(centroids)

    def run(batches):
        cells = sent.value
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            rows = []
            for d in set(cols[1]):
                own = [i for i, x in enumerate(cols[1]) if x == d]
                c = cells[d]
                x = np.frombuffer(b"".join(cols[4][i] for i in own), "<f8").reshape(-1, d)
                s = x @ c.T
                home = s.argmax(1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * np.clip(c @ c.T, -1, 1)))
                visit = s[np.arange(len(own)), home][:, None] - s <= chord * apart[home] + 1e-9
                visit &= np.arange(len(c))[None, :] <= home[:, None]
                for r, cell in zip(*(z.tolist() for z in np.nonzero(visit))):
                    i = own[r]
                    rows.append((cols[0][i], d, cell, cell == home[r], cols[2][i], cols[3][i], cols[4][i]))
            out = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["label", "dim", "cell", "home", "rep", "n", "vec"])

    return vectors.select("label", "dim", "rep", "n", "vec").mapInArrow(run, "label long, dim int, cell int, home boolean, rep long, n long, vec binary")


def link_blocks(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, same: bool) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links added to each vector by a pair of blocks, and edges that join what the pair's links join."""
    hit = x @ y.T >= threshold
    if same:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return {}, []
    more: dict[int, int] = {}
    for ids, k in ((a, hit @ nb), *(() if same else ((b, na @ hit),))):
        for i in np.flatnonzero(k).tolist():
            more[int(ids[i])] = more.get(int(ids[i]), 0) + int(k[i])
    rows, cols = hit.any(1), hit.any(0)
    hit = hit[rows][:, cols]
    ra, rb = a[rows], b[cols]
    la, lb = ra.copy(), rb.copy()
    big = np.iinfo(np.int64).max
    while True:
        low = np.minimum(la, np.where(hit, lb[None, :], big).min(1))
        lob = np.minimum(lb, np.where(hit, low[:, None], big).min(0))
        if (low == la).all() and (lob == lb).all():
            break
        la, lb = low, lob
    edges = {(int(i), int(j)) for i, j in zip([*ra, *rb], [*la, *lb]) if i != j}
    return more, list(edges)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, cell_size: int = 8192, cells: int | None = None, slack: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    clean = materialise(_clean(vectors), "vectors")
    grouped = clean.withColumn("key", F.md5("vec")).groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    own = materialise(grouped, "distinct-vectors")
    chord = float(np.sqrt(max(0.0, 2 - 2 * threshold))) if slack is None else slack
    centroids = {}
    for r in own.groupBy("dim").count().collect():  # one row for each dimension
        picked = own.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("key")).limit(SAMPLE).select("vec").collect()
        x = np.frombuffer(b"".join(bytes(p["vec"]) for p in picked), "<f8").reshape(-1, r["dim"])
        centroids[r["dim"]] = spherical_kmeans(x, cells or min(1024, max(1, r["count"] // cell_size)))
    dealt = _places(own, centroids, chord)
    sizes = materialise(dealt, "cells")
    count = sizes.groupBy("label", "dim", "cell", "home").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    count = materialise(count, "cell-sizes")
    keys = ["label", "dim", "cell"]
    packed = sizes.join(count.drop("size"), [*keys, "home"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    packed = packed.groupBy(*keys, "home", "block").agg(F.sort_array(F.collect_list(F.struct("rep", "n", "vec"))).alias("own"))
    packed = materialise(packed.select(*keys, "home", "block", F.col("own.rep").alias("reps"), F.col("own.n").alias("ns"), F.col("own.vec").alias("vecs")), "blocks")
    homes = count.where("home").select(*keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    others = count.select(*keys, F.col("home").alias("other"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    meet = homes.join(others, keys).where("not other or i <= j")  # pairs of blocks
    left = packed.where("home").select(*keys, F.col("block").alias("i"), F.col("reps").alias("ra"), F.col("ns").alias("na"), F.col("vecs").alias("va"))
    right = packed.select(*keys, F.col("home").alias("other"), F.col("block").alias("j"), F.col("reps").alias("rb"), F.col("ns").alias("nb"), F.col("vecs").alias("vb"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = meet.repartition(parts, *keys, "i", "j").join(left, [*keys, "i"]).join(right, [*keys, "other", "j"])

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for k in range(b.num_rows):
                row = {n: b.column(b.schema.get_field_index(n))[k] for n in ("dim", "i", "other", "j", "ra", "na", "va", "rb", "nb", "vb")}
                d = row["dim"].as_py()
                same = row["other"].as_py() and row["i"].as_py() == row["j"].as_py()
                x, y = (np.frombuffer(b"".join(row[n].as_py()), "<f8").reshape(-1, d) for n in ("va", "vb"))
                ids = [np.array(row[n].as_py(), np.int64) for n in ("ra", "rb", "na", "nb")]
                more, edges = link_blocks(x, y, ids[0], ids[1], ids[2], ids[3], threshold, same)
                out += [(i, None, n) for i, n in more.items()] + [(i, j, 0) for i, j in edges]
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v", "n"])

    found = materialise(pairs.select(*keys, "i", "other", "j", "ra", "na", "va", "rb", "nb", "vb").mapInArrow(run, "u long, v long, n long"), "links")
    joined = components(found.where("v is not null").select("u", "v"))
    links = found.where("v is null").groupBy("u").agg(F.sum("n").alias("more"))
    each = own.select("label", "dim", "key", "rep", "n").join(links.withColumnRenamed("u", "rep"), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    each = materialise(each.select("label", "dim", "key", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "groups")
    rows = clean.select("vec_id", "label", "dim", F.md5("vec").alias("key")).join(each, ["label", "dim", "key"]).groupBy("vec_id").agg(F.max("links").alias("n_links"), F.min("component").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(rows, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
