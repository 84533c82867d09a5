"""op1: toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text, one on what sets toxic text apart: stretches of words whose
n-grams are in toxic documents many times as often as in ordinary ones, by a likelihood-ratio test over documents (near copies count
once). A text is cut into windows of a word; each is compressed with the ordinary dictionary and with the toxic
dictionary put before the ordinary one. A window that the latter shortens holds something that toxic text has and ordinary text
does not; it is looked at again in windows of one word, which tells such words from savings that add up by chance. A logistic curve over the bytes saved, fitted on the training sample, calibrates the score.

Only a bounded sample of labelled rows is used to fit (``per_class`` documents of each label, by hash of doc_id); every
whole text is scored, in one pass without a shuffle. Null and empty texts score like a text that saves nothing. Without
labels of both classes every score is 0. Repeated rows are scored each; labels that are null are no labels; other columns
are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidied

WINDOW, GRAM = 48, 5
#: Both dictionaries end with it and every window ends with it: a block pays its headers under either, and no match is lost to
#: the last bytes of a block, where zstandard starts none.
LEAD = b"#0123456789abcdef0123456789ABCDEF#"
_WORD = re.compile(rb"[^ ]+")
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    """Lower case, with a space for everything that is no letter or digit."""
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(_SPACED) + b" "


def windows(b: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text in windows of as many whole words as fit; longer words are cut with an overlap."""
    out, own, n = [], [], 0
    for w in b.split():
        if len(w) > size:
            parts = [w[i : i + size] for i in range(0, max(1, len(w) - 16), size - 16)]
        else:
            parts = (w,)
        for x in parts:
            if n + len(x) >= size and own:
                out.append(b" ".join(own))
                own, n = [], 0
            own.append(x)
            n += len(x) + 1
    if own:
        out.append(b" ".join(own))
    return out


def _grams(word: bytes) -> list[tuple[int, bytes]]:
    """Starts and n-grams of a word between spaces: all of GRAM bytes, and longer ones at its start."""
    w = b" " + word + b" "
    return [(i, w[i : i + GRAM]) for i in range(max(1, len(w) - GRAM + 1))] + [(0, w[:k]) for k in range(GRAM + 1, min(len(w), 14) + 1)]


def _g2(a: int, n1: int, b: int, n0: int) -> float:
    def term(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n - k else 0.0)

    p = (a + b) / (n1 + n0)
    return 2 * (term(a, n1, a / n1) + term(b, n0, b / n0) - term(a, n1, p) - term(b, n0, p))


def _distinct(texts: list[bytes]) -> list[bytes]:
    """Texts of which no earlier one shares one of the three least shingle hashes."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = _WORD.findall(t)
        own = sorted({zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))})[:3]
        if not seen.intersection(own):
            out.append(t)
        seen.update(own)
    return out


class Model:
    """Two dictionaries and the curve."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: list[float]):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights
        self._c, self._known = None, {}

    def __getstate__(self):
        return (self.ordinary, self.toxic, self.weights)

    def __setstate__(self, s):
        self.__init__(*s)

    def _compressors(self):
        if self._c is None:
            import zstandard as z

            def one(raw: bytes):
                params = z.ZstdCompressionParameters(window_log=15, chain_log=15, hash_log=15, search_log=5, min_match=4, target_length=32, strategy=z.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
                d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                return z.ZstdCompressor(dict_data=d, compression_params=params).compress

            self._c = one(self.ordinary + LEAD), one(self.toxic + self.ordinary + LEAD)
        return self._c

    def saved(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves on a window."""
        ordinary, both = self._compressors()
        w = b" " + window + b" " + LEAD
        return len(ordinary(w)) - len(both(w))

    def _word(self, word: bytes) -> int:
        """saved() of one word, kept for a while."""
        d = self._known.get(word)
        if d is None:
            if len(self._known) >= 200_000:
                self._known.clear()
            d = self._known[word] = self.saved(word)
        return d

    def features(self, text: str | None) -> list[float]:
        """How many windows save 4 bytes, how many of the words of windows that save anything save 2, 3 and 4, as logarithms; words that save 3, in a
        hundred; the most that a word saves."""
        own = windows(plain(text))
        gains = [self.saved(w) for w in own]
        fine = [self._word(x) for w, d in zip(own, gains) if d > 0 for x in w.split()]
        n = [sum(d >= k for d in fine) for k in (2, 3, 4)]
        size = sum(w.count(b" ") + 1 for w in own)
        return [math.log1p(sum(d >= 4 for d in gains)), *map(math.log1p, n), min(10.0, 100 * n[1] / max(size, 1)), float(max(fine, default=0) if n[0] else 0)]

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        x = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit(texts: list[str | None], labels: list[int], prior: float | None = None, ratio: float = 10.0, test: float = 25.0, dictionary: int = 2048) -> Model:
    """Fits on texts with labels 0 and 1. prior: the share of label 1 among all labelled rows, of which the texts are a sample."""
    import zstandard as z

    every = [plain(t) for t in texts]
    toxic = _distinct([t for t, y in zip(every, labels) if y])
    ordinary = _distinct([t for t, y in zip(every, labels) if not y])
    if not toxic or not ordinary:
        return Model(b" ", b" ", [])
    df1 = Counter(g for t in toxic for g in {g for w in set(_WORD.findall(t)) for _, g in _grams(w)})
    df0 = Counter(g for t in ordinary for g in {g for w in set(_WORD.findall(t)) for _, g in _grams(w)})
    n1, n0 = len(toxic), len(ordinary)
    apart = {g for g, a in df1.items() if a >= 3 and a / n1 > ratio * (df0[g] + 0.5) / n0 and _g2(a, n1, df0[g], n0) > test}
    spans: Counter[bytes] = Counter()  # by documents
    for t in toxic:
        own = set()
        for word in set(_WORD.findall(t)):
            w = b" " + word + b" "
            at = end = -1
            for i, g in sorted(x for x in _grams(word) if x[1] in apart):
                if i > end:
                    if at >= 0:
                        own.add(w[at:end])
                    at = i
                end = max(end, i + len(g))
            if at >= 0:
                own.add(w[at:end])
        spans.update(own)
    if not spans:
        spans.update({w: 1 for t in toxic for w in t.split()})

    def train(samples: list[bytes], size: int) -> bytes:
        try:
            return z.train_dictionary(size, samples, k=32 if size > 1024 else 16, d=6).as_bytes()
        except z.ZstdError:  # too few samples for the trainer
            return b"".join(dict.fromkeys(samples))[-size:]

    common = [b" " + w + b" " for t in ordinary for w in t.split()][:200_000]
    kept = [s for s, k in spans.most_common() if k >= max(1, 0.005 * n1)] or list(spans)
    # the trainer weighs fragments by how often they are given: as often as documents hold them
    trained = train([s for s in kept for _ in range(spans[s])], dictionary)
    missing = [s for s in kept if s not in trained and len(s) >= GRAM][: dictionary // GRAM]
    model = Model(train(common, 2 * dictionary), trained[-dictionary:] + b"".join(reversed(missing)), [0.0])
    x = np.array([[1.0, *model.features(t)] for t in texts])
    y = np.array(labels, float)
    share = y.mean()
    prior = share if prior is None else prior
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *([1e-2] * (x.shape[1] - 1))]) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * 0.01 + np.eye(x.shape[1]) * 1e-9
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.01 * ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w.tolist()
    return model


def training_rows(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list, list[int], float | None]:
    """Texts and labels, and the share of label 1 in all such rows, of at most per_class rows of each label, those with the least hash of doc_id, from the rows whose
    crc32(doc_id) mod 5 is not 0; of documents with one doc_id the least text counts; the same label twice for a document counts once, contradictory labels not at all."""
    own = labels.where(F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    own = own.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y1")).where("y = y1")
    picked = [own.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "y") for k in (0, 1)]
    both = picked[0].union(picked[1])  # at most 2 * per_class rows
    n = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    rows = documents.select("doc_id", "text").join(F.broadcast(both), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [r["text"] for r in rows], [int(r["y"]) for r in rows], (n.get(1, 0) / sum(n.values()) if len(n) == 2 else None)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents with score double and predicted int (columns of these names are replaced). The model is a few kilobytes."""
    documents = documents.drop("score", "predicted")
    sent = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    extra = "score double, predicted int"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)

    def run(batches):
        m, k = sent.value, names.index("text")
        for b in (b for batch in batches for b in slices(batch, k)):
            s = [m.score(t) for t in b.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*names, "score", "predicted"])
        m._known.clear()

    return documents.mapInArrow(tidied(run), f"{kinds}, {extra}")


def op1_toxicity(spark: SparkSession, sf_dir: str, per_class: int = 1500) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*training_rows(docs, table(spark, sf_dir, "labels"), "toxic", per_class))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")
