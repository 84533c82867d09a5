"""op4: personal data, and terms that reveal it.

Base kinds are found by pattern (email, ip, card, phone). Strings of letters and digits that carry more than SECRET bits of information
(their length times the entropy of their characters) are secrets: no text has them by chance. Values of the base kinds and secrets are protected.
Over the whole corpus, the pointwise mutual information of a protected value c and a
term t that stands anywhere in the same text, log(N n_ct / (n_c n_t)), says how much of the value's information log(N / n_c) the term
gives away; a term that gives the share ``alpha`` of it or more discloses it. Every term of every value is tested (``support`` 1: most
values are unique); against chance the test takes (N + 1) / (n_t + s) for N / n_t, so that a term seen once needs a corpus in which one
meeting says enough: s is 1 (N >= 2 ** (1 / (1 - alpha)), 1024) for terms that stay away from the value, down to 1/2 (58) for those that
are always among the NEAR words to a side of it. In the texts that hold the value all occurrences of the term become spans of kind ``term``:
removed if they give all of it away, generalised otherwise. N, n_c, n_t and n_ct all count different texts, so that copies neither add evidence
nor take it away. All statistics cover all documents. Null texts count as empty; repeated rows are found each; other columns stay as they
are in sanitise() and are dropped in find().
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, discard, in_bitmap, materialise, slices, table, tidied

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE, TERM = 4, 5  # base kinds are the first four
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ALPHA, SUPPORT, NEAR, SECRET = 0.9, 1, 8, 80.0


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start, then kind."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)]
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    out.sort()
    return out


def information(token: str) -> float:
    """Bits of a string: its length times the entropy of its characters."""
    n = len(token)
    return -sum(k * math.log2(k / n) for k in Counter(token).values())


def protected_spans(text: str) -> list[tuple[int, int, int]]:
    """base_spans() and the secrets that meet none of them. A secret has letters and at least three digits."""
    out = base_spans(text)
    more = []
    for m in _KEY.finditer(text):
        if len(_DIGITS.findall(m[0])) >= 3 and _LETTER.search(m[0]) and information(m[0]) > SECRET:
            if not any(s < m.end() and e > m.start() for s, _, e in out):
                more.append((m.start(), BASE, m.end()))
    return sorted(out + more)


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def words_outside(text: str, spans) -> list[tuple[str, int, int]]:
    """(term, start, end) of every word of which no part is in a protected span, in order."""
    out, k, end = [], 0, 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            end = max(end, spans[k][2])
            k += 1
        if m.start() >= end:
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def postings(text: str) -> tuple[list[str], dict[str, set[int]]]:
    """The different values of a text, and its terms with the numbers of the values that they stand beside: among NEAR words to a side."""
    spans = protected_spans(text)
    own = words_outside(text, spans)
    starts = [a for _, a, _ in own]
    values: dict[str, int] = {}
    terms: dict[str, set[int]] = {w: set() for w, _, _ in own}
    for s, _, e in spans:
        c = values.setdefault(text[s:e], len(values))
        before, after = bisect_left(starts, s), bisect_left(starts, e)
        for w, _, _ in own[max(0, before - NEAR) : before] + own[after : after + NEAR]:
            terms[w].add(c)
    return list(values), terms


_COUNTS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string"
_FOUND = _COUNTS + ", key binary, text string"


def _find(texts: list) -> list[pa.Array]:
    """The columns of _FOUND; text only where it holds a value."""
    counts, shas, bases, keys, held = [[] for _ in range(4)], [], [], [], []
    for t in texts:
        t = t or ""
        spans = protected_spans(t)
        for k in range(4):
            counts[k].append(sum(x[1] == k for x in spans))
        said = spell([x for x in spans if x[1] < BASE])
        shas.append(hashlib.sha256(said.encode()).hexdigest())
        bases.append(said)
        keys.append(hashlib.sha256(t.encode()).digest())
        held.append(t if spans else None)
    return [*(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array(bases), pa.array(keys, pa.binary()), pa.array(held, pa.string())]


def _postings(batches):
    for b in (b for batch in batches for b in slices(batch, 1, 200_000)):
        values, terms = [], []
        for t in b.column(1).to_pylist():
            v, own = postings(t)
            values.append(v)
            terms.append([{"term": w, "beside": sorted(c)} for w, c in own.items()])
        kind = pa.list_(pa.struct([("term", pa.string()), ("beside", pa.list_(pa.int32()))]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.list_(pa.string())), pa.array(terms, kind)], names=["key", "values", "terms"])


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in words], np.uint64)


def _hashed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(b.column(0).to_pylist()).view(np.int64), pa.int64())], names=["hash"])


def frequencies(documents: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_t): how many different texts hold each wanted term (further terms may be there). Bitmaps of fixed size say which terms may be
    wanted and which texts may have copies; only the words of these are shuffled to count copies once."""
    sc = documents.sparkSession.sparkContext
    terms = sc.broadcast(bitmap(wanted.mapInArrow(_hashed, "hash long")))
    copied = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = sc.broadcast(bitmap(copied.select(F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long").alias("hash"))))

    def words(copies: bool):
        def run(batches):
            for b in (b for batch in batches for b in slices(batch, 0, 1_000_000)):
                texts = [t or "" for t in b.column(0).to_pylist()]
                keys = [hashlib.sha256(t.encode()).digest() for t in texts]
                may = in_bitmap(copied.value, np.array([int.from_bytes(k[:7], "big") for k in keys], np.uint64))
                out = []
                for k in np.flatnonzero(may == copies).tolist():
                    own = list({w.lower() for w in set(_TERM.findall(texts[k]))})
                    own = [own[j] for j in np.flatnonzero(in_bitmap(terms.value, _hashes(own))).tolist()]
                    if own:
                        out.append((keys[k], " ".join(sorted(own))))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["key", "words"])

        return documents.select("text").mapInArrow(tidied(run), "key binary, words string")

    texts = words(False).select("words").union(words(True).dropDuplicates(["key"]).select("words"))
    return texts.select(F.explode(F.split("words", " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def disclosing(found: DataFrame, documents: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(key, terms array<(term, share)>): by text, the terms that give away the share alpha or more of the information of one of its values."""
    held = found.where(F.col("text").isNotNull()).select("key", "text").dropDuplicates(["key"])
    own = materialise(held.mapInArrow(tidied(_postings), "key binary, values array<string>, terms array<struct<term:string,beside:array<int>>>").withColumn("id", F.monotonically_increasing_id()), "postings")
    n = found.select("key").distinct().count()
    # values that stand in just the same texts have the same counts: one class
    values = own.select("id", F.posexplode("values").alias("at", "value"))
    same = values.groupBy("value").agg(F.count(F.lit(1)).alias("n_c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    same = same.where(F.col("n_c") < n)
    most = same.agg(F.max("n_c")).first()[0] or 0  # one number
    classes = values.join(same, "value").groupBy("id", "n_c", "x", "y").agg(F.collect_list("at").alias("at"))
    # n_ct <= n_c, so log((N + 1) n_ct / (n_c (n_t + s))) >= alpha log(N / n_c) bounds n_t: terms that are too frequent for any value drop out at once
    limit = lambda c: 1.000001 * (n + 1) / max(n, 1) * c * F.pow(F.lit(float(n)) / c, F.lit(alpha)) - 0.5
    rare = frequencies(documents, found, own.select(F.explode("terms.term"))).where(F.col("n_t") <= (limit(F.lit(float(most))) if most else F.lit(0.0)))
    terms = own.select("id", F.explode("terms").alias("t")).select("id", "t.term", "t.beside").join(rare, "term")
    pairs = terms.join(classes, "id").where(F.col("n_t") <= limit(F.col("n_c").cast("double")))
    pairs = materialise(pairs.select("id", "term", "n_t", "n_c", "x", "y", F.arrays_overlap("beside", "at").cast("int").alias("beside")), "pairs")
    met = pairs.groupBy("n_c", "x", "y", "term").agg(F.first("n_t").alias("n_t"), F.count(F.lit(1)).alias("n_ct"), F.avg("beside").alias("near"))
    whole = F.log(F.lit(float(n)) / F.col("n_c"))
    share = F.log(F.lit(float(n)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))) / whole
    tested = F.log(F.lit(n + 1.0) * F.col("n_ct") / (F.col("n_c") * (F.col("n_t") + 1 - F.col("near") / 2))) / whole
    met = met.where((F.col("n_ct") >= support) & (tested >= alpha)).select("n_c", "x", "y", "term", F.when(F.col("n_ct") >= F.col("n_t"), 1.0).otherwise(share).alias("share"))
    marks = pairs.join(met, ["n_c", "x", "y", "term"]).groupBy("id", "term").agg(F.max("share").alias("share"))
    marks = marks.groupBy("id").agg(F.collect_list(F.struct("term", "share")).alias("terms"))
    marks = materialise(marks.join(own.select("id", "key"), "id").select("key", "terms"), "marks")
    discard(own, pairs)
    return marks


def occurrences(text: str, spans, terms) -> list[tuple[int, int, float]]:
    """(start, end, share) of every occurrence of the disclosing terms."""
    share = {x["term"]: x["share"] for x in terms or []}
    return [(a, b, share[w]) for w, a, b in words_outside(text, spans) if w in share] if share else []


def find(documents: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """Counts and hash of the base spans, all spans, and the numbers of secrets, terms and all spans of each document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    more = ["n_secret", "n_term", "n_spans"]

    def run(batches):
        for b in (b for batch in batches for b in slices(batch, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), *_find(b.column(1).to_pylist())], names=[*names, "base", "key", "text"])

    found = materialise(docs.mapInArrow(tidied(run), "doc_id long, " + _FOUND), "private")
    marks = disclosing(found, docs, alpha, support)

    def add(batches):
        for b in (b for batch in batches for b in slices(batch, 6)):
            said, counts = [], ([], [], [])
            for t, terms in zip(b.column(6).to_pylist(), b.column(7).to_pylist()):
                spans = protected_spans(t)
                every = sorted([*spans, *((a, TERM, e) for a, e, _ in occurrences(t, spans, terms))])
                said.append(spell(every))
                for c, x in zip(counts, (sum(k == BASE for _, k, _ in every), sum(k == TERM for _, k, _ in every), len(every))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(said, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=[*names, "spans", *more])

    held = found.where(F.col("text").isNotNull()).join(marks, "key", "left").select(*names, "text", "terms")
    kinds = "doc_id long, " + _COUNTS.replace(" base string", " spans string") + "".join(f", {x} long" for x in more)
    none = found.where(F.col("text").isNull()).select(*names, F.col("base").alias("spans"), *(F.lit(0).cast("long").alias(x) for x in more))
    return none.union(held.mapInArrow(tidied(add), kinds))


def redact(text: str, spans, extra) -> str:
    """Protected spans become their kind; terms are removed if they give the whole value away, else generalised to a placeholder."""
    marks = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in spans] + [(a, b, "" if share >= 1 else "[TERM]") for a, b, share in extra]
    out, at = [], 0
    for s, e, mark in sorted(marks, key=lambda m: (m[0], -m[1])):
        if e <= at:
            continue
        out += [text[at : max(s, at)], mark]
        at = e
    return "".join(out) + text[at:]


def sanitise(documents: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """documents with personal data and disclosing terms taken out of text; all rows and columns stay."""
    docs = documents.select(F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in (b for batch in batches for b in slices(batch, 0)):
            yield pa.RecordBatch.from_arrays(_find(b.column(0).to_pylist())[6:], names=["key", "text"])

    found = materialise(docs.mapInArrow(tidied(run), "key binary, text string"), "private")
    marks = disclosing(found, docs, alpha, support)
    names = documents.columns
    both = documents.withColumn("__key", F.unhex(F.sha2("text", 256))).join(marks.select(F.col("key").alias("__key"), F.col("terms").alias("__terms")), "__key", "left").select(*names, "__terms")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)

    k = names.index("text")

    def clean(batches):
        for b in (b for batch in batches for b in slices(batch, k)):
            texts, more = b.column(k).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            new = []
            for t, terms in zip(texts, more):
                spans = protected_spans(t or "")
                new.append(None if t is None else redact(t, spans, occurrences(t, spans, terms)))
            cols = list(b.columns[:-1])
            cols[k] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return both.mapInArrow(tidied(clean), kinds)


def op4_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
