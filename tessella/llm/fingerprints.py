"""op2 [native]: bottom-k fingerprints of documents, in SQL functions only.

A document's shingles are its runs of five words (white-space separated; fewer words: all of them as one; none: no shingle). The fingerprint
is the k least distinct 64-bit shingle hashes, ascending. Fingerprints merge: the k least hashes of two fingerprints are that of
both texts together, so parts may be sketched anywhere. From fingerprints come the resemblance, the containment and the number
of distinct shingles. As strings they are the base64 form of the hashes; equal texts have equal strings.

Null texts count as empty. Two empty fingerprints resemble by 1, an empty and another by 0. Documents follow one another by
(doc_id, text), nulls first; repeated rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, range_bounds, table

K, WORDS = 256, 5
LOWEST = -(2**63)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The fingerprint of a text column as array<bigint>."""

    def hashes(w: Column) -> Column:
        first = lambda i: F.xxhash64(*[F.get(w, i + F.lit(j)) for j in range(words)])
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))), first)
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(many)), 1, k))

    split = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.get(F.transform(F.array(split), hashes), F.lit(0))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The Jaccard similarity of the shingle sets: the share of the k least hashes of both that are in each."""

    def share(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))

    return F.get(F.transform(F.array(merge(a, b, k)), share), F.lit(0)).cast("double")


def distinct(a: Column, k: int = K) -> Column:
    """The number of distinct shingles: exact below k, else (k - 1) over the share of the hash range that the k least fill."""
    last = F.element_at(a, -1).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((last + F.lit(2.0**63)) / F.lit(2.0**64)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has, from the resemblance and the counts."""
    j = resemblance(a, b, k)
    both = j * (distinct(a, k) + distinct(b, k)) / (1 + j)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct(a, k)))


def as_string(a: Column) -> Column:
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))), "[\r\n]", "")


def with_next(documents: DataFrame, buckets: int) -> DataFrame:
    """(bucket, sentinel, key, doc_id, text) for each document, dealt by ranges of doc_id; each bucket's first document also
    follows the last one of the bucket before (the very first one that of the last bucket), so that a window over a bucket sees
    each document's successor. Only the cut points and each bucket's least doc_id come to the driver."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
    cut = bucket_of("key", range_bounds(docs.select("key"), "key", buckets), fan=max(2, int(buckets**0.5)))
    docs = docs.withColumn("bucket", cut)
    least = {r["bucket"]: r["k"] for r in docs.groupBy("bucket").agg(F.min("key").alias("k")).collect()}
    own = sorted(least)
    before = {b: own[i - 1] for i, b in enumerate(own)}  # of the first: the last
    size = (own[-1] if own else 0) + 1
    first = F.array(*[F.lit(least.get(b)).cast("long") for b in range(size)])
    target = F.array(*[F.lit(before.get(b, 0)).cast("int") for b in range(size)])
    here = F.struct(F.col("bucket"), F.lit(0).alias("sentinel"))
    there = F.struct(F.get(target, F.col("bucket")).alias("bucket"), F.lit(1).alias("sentinel"))
    places = F.when(F.get(first, F.col("bucket")) == F.col("key"), F.array(here, there)).otherwise(F.array(here))
    return docs.select("doc_id", "text", "key", F.explode(places).alias("p")).select("p.bucket", "p.sentinel", "key", "doc_id", "text")


def fingerprint_pairs(documents: DataFrame, k: int = K) -> DataFrame:
    """Each document with its fingerprint, its edited text's (see op2's contract) and their likenesses. One shuffle of the text."""
    spark = documents.sparkSession
    rows = with_next(documents, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    w = Window.partitionBy("bucket").orderBy("sentinel", "key", "text")
    rows = rows.withColumn("next", F.lead("text").over(w))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))
    rows = rows.select("bucket", "sentinel", "key", "text", "doc_id", n.cast("long").alias("n_chars"), F.when(F.col("sentinel") == 0, edited).alias("edited"))
    rows = rows.withColumn("own", sketch(F.col("text"), k)).withColumn("other", sketch(F.col("edited"), k)).withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    rows = rows.withColumn("after", F.lead("own").over(w)).where("sentinel = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"), as_string(F.col("other")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("other"), k).alias("near_edited"), resemblance(F.col("own"), F.col("after"), k).alias("near_next"), F.round(distinct(F.col("own"), k)).cast("long").alias("n_distinct"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
