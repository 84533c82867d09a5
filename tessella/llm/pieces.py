"""op6: SentencePiece encoding and decoding by a Viterbi pass in batched numpy.

Words of equal length advance together, one place at a time. Every substring up to the longest piece is hashed and looked up in the sorted
hashes of the pieces. At each place, over the pieces that end there, a vectorised maximum picks the best way to it and stores
a back-pointer; the ids are read from the back-pointers.

For a unigram model, ways are scored by the sum of their pieces' scores. A BPE model (the one supplied, piece_bpe_32k) has merge ranks for scores,
whose sums mean nothing. There, a way is open (0) or closed (-infinity) by its pairs of neighbours: pieces x, y may follow one another
if merging the text xy gives x, y again, and a sequence is what merging gives if and only if all its neighbours may follow one another, so just one
way to each place is open. Whether a pair is open is found by undoing merges from the seam, the later one first, all pairs
of a place together: the pair is closed if the two symbols at the seam, while they stood there, would have been merged before either
was merged to the other side. Answers are kept in a table. This needs parts to be merged before wholes and no two pieces of one
rank; words with a piece that breaks this (runs of spaces in the supplied model) are merged step by step, in batches too.

Characters without a piece become byte pieces. Null texts count as empty; repeated rows are encoded each; other columns are dropped; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, slices, table, tidied

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BARE = "\ufdd0"  # a code point that Unicode keeps out of texts


_BITS = 20


def _finish(raw: np.ndarray, length) -> np.ndarray:
    h = (raw ^ (np.asarray(length, np.uint64) * np.uint64(0x9E3779B1))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _substrings(points: np.ndarray, most: int):
    """For each length up to most, the hashes of all substrings of that length in rows of code points."""
    points = points.astype(np.uint64) + np.uint64(1)
    raw = np.zeros_like(points)
    for k in range(1, most + 1):
        n = points.shape[1] - k + 1
        raw = raw[:, :n] * _BASE + points[:, k - 1 : k - 1 + n]
        yield k, _finish(raw, k)


def _raw(text: str) -> int:
    """The hash of a whole string before _finish: of x + y it is raw(x) * _BASE ** len(y) + raw(y)."""
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
    return h


_SLOTS = 21  # bits of the table of pairs
_NONE, _BEGIN, _OTHER = -3, -2, -1  # no way here, the start of a word, a character without a piece


class Pieces:
    """A model's pieces, as sorted hashes with scores and ids."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], unigram: bool, dummy_prefix: bool = True):
        self.pieces, self.unigram, self.prefix = pieces, unigram, dummy_prefix
        own = [i for i, k in enumerate(kinds) if k in (1, 4)]
        self.unk = next((i for i, k in enumerate(kinds) if k == 2), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        self.longest = max((len(pieces[i]) for i in own), default=1)
        self.crossing = any(SPACE in pieces[i].lstrip(SPACE) for i in own)
        raw = np.array([_raw(pieces[i]) for i in own], np.uint64)
        keys = _finish(raw, np.array([len(pieces[i]) for i in own], np.uint64))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(own, np.int64)[order]
        if len(np.unique(self.keys)) != len(own):
            raise ValueError("two pieces have one hash")
        top, first, often = np.unique((self.keys >> np.uint64(64 - _BITS)).astype(np.int64), return_index=True, return_counts=True)
        self.first = np.full(1 << _BITS, -1, np.int32)  # where the keys with these first bits begin
        self.first[top] = first
        self.run = int(often.max(initial=1))
        self.keys = np.concatenate([self.keys, np.full(self.run, self.keys[-1] if len(own) else 0, np.uint64)])
        self.scores = np.array([scores[i] for i in own], np.float64)[order]
        self.table = {pieces[i]: (scores[i], i) for i in own}
        self.floor = (min(scores[i] for i in own) if own else 0.0) - 10.0
        said = [b"" if k == 3 else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds)]
        for i, x in self.byte_of.items():
            said[i] = bytes([x])
        said[self.unk] = " ⁇ ".encode()
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.lengths = np.array([len(x) for x in said], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        if not unigram:
            self._parts(own, raw)

    @classmethod
    def load(cls, path: str) -> "Pieces":
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        return cls([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], m.trainer_spec.model_type == 1, norm.add_dummy_prefix)

    def _parts(self, own: list[int], raw: np.ndarray) -> None:
        """For each piece its size, hash, rank and the two pieces that its last merge joins; and which pieces break the order."""
        n = len(self.pieces)
        self.size, self.raw = np.zeros(n, np.int64), np.zeros(n, np.uint64)
        self.rank, self.left, self.right = np.full(n, np.inf), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.unordered = np.zeros(n, bool)
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        by: dict[int, list[int]] = {}
        for i, h in zip(own, raw):
            self.size[i], self.raw[i] = len(self.pieces[i]), h
            self.rank[i] = -np.inf if len(self.pieces[i]) == 1 else -self.table[self.pieces[i]][0]
            by.setdefault(len(self.pieces[i]), []).append(i)
        ranks, often = np.unique(self.rank[np.isfinite(self.rank)], return_counts=True)
        self.unordered |= np.isin(self.rank, ranks[often > 1])
        for size, ids in by.items():
            if size == 1:
                continue
            ids = np.array(ids)
            score, ident = self._lookup([self.pieces[i] for i in ids], size)
            score[size] = -np.inf  # the last merge is left out
            span = self._merge(score.astype(np.float32), len(ids), size, size)
            first = span[:, 0]
            rest = size - first
            two = (span > 0).sum(1) == 2
            rows = np.flatnonzero(two)
            self.left[ids[rows]] = ident[first[rows], rows, 0]
            self.right[ids[rows]] = ident[rest[rows], rows, first[rows]]
            self.unordered[ids[~two]] = True
        halves = np.stack([self.left, self.right])
        big = halves[0] >= 0
        self.unordered[big] |= (halves[:, big] < 0).any(0) | (self.rank[halves[:, big]] >= self.rank[big]).any(0)
        if {c for p in self.table for c in p} - self.table.keys():
            self.unordered[own] = True  # merges of characters that are no pieces
        self.pair_keys, self.pair_open = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, bool)

    def _where(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashed strings are pieces, and the places of these among the keys."""
        at = self.first[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
        k = np.flatnonzero(at >= 0)
        at, own = at[k].astype(np.int64), h[k]
        hit = self.keys[at] == own
        for j in range(1, self.run):
            more = np.flatnonzero(~hit)
            good = self.keys[at[more] + j] == own[more]
            at[more[good]] += j
            hit[more[good]] = True
        return k[hit], at[hit]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The ids of hashed strings, -1: no piece."""
        out = np.full(len(h), -1, np.int64)
        k, at = self._where(h)
        out[k] = self.ids[at]
        return out

    def _may_follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of pieces merging leaves as they are."""
        out = np.ones(len(x), bool)
        tx, ty = np.full(len(x), np.inf), np.full(len(x), np.inf)  # when the symbol at the seam is merged away from it
        live = np.arange(len(x))
        while len(live):
            size = self.size[x] + self.size[y]
            short = size <= self.longest
            c = np.full(len(x), np.inf)
            c[short] = self._rank_of(self.raw[x[short]] * self.powers[self.size[y[short]]] + self.raw[y[short]], size[short])
            closed = (c < tx) & (c <= ty) & (c < np.inf)  # of equal ranks the leftmost merges first
            out[live[closed]] = False
            later = self.rank[x] > self.rank[y]
            go = ~closed & ((self.left[x] >= 0) | (self.left[y] >= 0))
            live, x, y, tx, ty, later = live[go], x[go], y[go], tx[go], ty[go], later[go]
            tx, ty = np.where(later, self.rank[x], tx), np.where(later, ty, self.rank[y])
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return out

    def _rank_of(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self._find(_finish(raw, size.astype(np.uint64)))
        return np.where(at >= 0, self.rank[at], np.inf)

    def _open(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """_may_follow with a table of earlier answers; what is no piece lets everything follow."""
        key = ((x + 3).astype(np.uint64) << np.uint64(32)) + (y + 3).astype(np.uint64)
        slot = ((key * _BASE) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        known = self.pair_keys[slot] == key
        out = self.pair_open[slot]
        if not known.all():
            miss = np.flatnonzero(~known)
            new, at, back = np.unique(key[miss], return_index=True, return_inverse=True)
            u, v = x[miss[at]], y[miss[at]]
            answer = np.ones(len(new), bool)
            both = np.flatnonzero((u >= 0) & (v >= 0))
            answer[both] = self._may_follow(u[both], v[both])
            out[miss] = answer[back]
            self.pair_keys[slot[miss]], self.pair_open[slot[miss]] = key[miss], answer[back]
        return out

    def _hits(self, words: list[str], most: int):
        """(length, word, start, place among the keys) of all substrings of words of one length that are pieces."""
        n, size = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size)
        for k, h in _substrings(points, most):
            i, at = self._where(h.ravel())
            yield k, i // h.shape[1], i % h.shape[1], at

    def _lookup(self, words: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (-1: none) of the substrings of words of one length, by length, word and start."""
        n, size = len(words), len(words[0])
        score = np.full((most + 1, n, size), -np.inf, np.float32 if not self.unigram else np.float64)
        ident = np.full((most + 1, n, size), -1, np.int32)
        for k, r, c, at in self._hits(words, most):
            score[k, r, c], ident[k, r, c] = self.scores[at], self.ids[at]
        return score, ident

    def _best(self, score: np.ndarray, n: int, size: int, most: int) -> np.ndarray:
        """Back-pointers of a unigram model: the length of the best way's last piece at each place of each word."""
        back, rows = np.zeros((n, size + 1), np.int64), np.arange(n)
        score[1] = np.where(np.isinf(score[1]), self.floor, score[1])
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        for end in range(1, size + 1):
            k = np.arange(1, min(most, end) + 1)
            own = best[:, end - k].T + score[k, :, end - k]
            at = own.argmax(0)
            best[:, end], back[:, end] = own[at, rows], k[at]
        return back

    def _only(self, words: list[str], size: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Back-pointers of a BPE model, the last piece at each place of each word, and which words must be merged step by step."""
        n = len(words)
        back, last = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), _NONE, np.int64)
        last[:, 0] = _BEGIN
        stepwise, none = np.zeros(n, bool), np.ones((n, size), bool)
        found = []
        for k, r, c, at in self._hits(words, most):
            i = self.ids[at]
            stepwise[r[self.unordered[i]]] = True
            if k == 1:
                none[r, c] = False
            found.append((c + k, r, c, i))
        r, c = np.nonzero(none)  # characters without a piece
        found.append((c + 1, r, c, np.full(len(r), _OTHER, np.int64)))
        end, r, c, i = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(end.astype(np.int32), kind="stable")
        r, c, i = r[order], c[order], i[order]
        cut = np.searchsorted(end[order], np.arange(1, size + 2))
        for e in range(1, size + 1):
            own = slice(cut[e - 1], cut[e])
            w, at, y = r[own], c[own], i[own]
            ok = np.flatnonzero(self._open(last[w, at], y))
            w = w[ok]
            last[w, e], back[w, e] = y[ok], e - at[ok]
        return back, last, stepwise

    def _chain(self, back: np.ndarray, size: int) -> np.ndarray:
        """The pieces' lengths at their starts, from back-pointers."""
        n = len(back)
        span = np.zeros((n, size), np.int64)
        rows, end = np.arange(n), np.full(n, size)
        while len(rows):
            k = back[rows, end]
            end = end - k
            span[rows, end] = k
            rows, end = rows[end > 0], end[end > 0]
        return span

    def _rows(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, as bytes."""
        n, size = len(words), len(words[0])
        most = min(self.longest, size)
        if self.unigram:
            score, ident = self._lookup(words, most)
            span = self._chain(self._best(score, n, size, most), size)
            at, cols = np.nonzero(span)
            ids = ident[span[at, cols], at, cols]
        else:
            back, last, stepwise = self._only(words, size, most)
            if stepwise.any():
                back[stepwise], last[stepwise] = 0, _NONE
                score, ident = self._lookup([words[k] for k in np.flatnonzero(stepwise).tolist()], most)
                own = self._merge(score, int(stepwise.sum()), size, most)
                k, c = np.nonzero(own)
                at = np.flatnonzero(stepwise)[k]
                back[at, c + own[k, c]], last[at, c + own[k, c]] = own[k, c], ident[own[k, c], k, c]
            span = self._chain(back, size)
            at, cols = np.nonzero(span)
            ids = last[at, cols + span[at, cols]]
        ends = np.searchsorted(at, np.arange(n), "right")
        flat = ids.astype("<u4").tobytes()
        cut = [0, *(4 * ends).tolist()]
        out = [flat[a:b] for a, b in zip(cut, cut[1:])]
        if (ids < 0).any():
            for r in np.unique(at[ids < 0]).tolist():
                mine = range(ends[r - 1] if r else 0, ends[r])
                parts = ([int(ids[j])] if ids[j] >= 0 else self._unknown(words[r][cols[j] : cols[j] + span[r, cols[j]]]) for j in mine)
                out[r] = np.array([x for p in parts for x in p], "<u4").tobytes()
        return out

    def _merge(self, score: np.ndarray, n: int, size: int, most: int) -> np.ndarray:
        """The lengths of the symbols left, at their starts, after every word has merged its best pair again and again."""
        stop = np.tile(np.arange(1, size + 1, dtype=np.int64), (n, 1))  # of the symbol that starts here
        before = np.tile(np.arange(-1, size - 1, dtype=np.int64), (n, 1))
        start = np.ones((n, size), bool)
        pair = np.full((n, size), -np.inf, np.float32)  # of the symbol that starts here and the next
        if most > 1:
            pair[:, : size - 1] = score[2, :, : size - 1]
        live = np.arange(n)
        while len(live):
            own = pair[live]
            at = own.argmax(1)  # the leftmost among equals
            hit = own[np.arange(len(live)), at] > -np.inf
            live, at = live[hit], at[hit]
            mid = stop[live, at]
            end = stop[live, mid]
            stop[live, at] = end
            start[live, mid] = False
            pair[live, mid] = -np.inf
            inner = end < size
            before[live[inner], end[inner]] = at[inner]
            right = np.where(inner, stop[live, np.where(inner, end, 0)] - at, 0)
            ok = inner & (right <= most)
            pair[live, at] = np.where(ok, score[np.where(ok, right, 0), live, at], -np.inf)
            left = before[live, at]
            has = left >= 0
            r, c = live[has], left[has]
            length = end[has] - c
            ok = length <= most
            pair[r, c] = np.where(ok, score[np.where(ok, length, 0), r, c], -np.inf)
        return np.where(start, stop - np.arange(size), 0)

    def _unknown(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode("utf-8", "replace")] if self.byte else [self.unk]

    def words(self, text: str) -> list[str]:
        """The parts of a text that no piece crosses."""
        if not text:
            return []
        if not self.crossing and self.prefix and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")  # each stands for a space and itself
        own = (" " if self.prefix else "") + text
        own = own.replace(" ", SPACE)
        return [own] if self.crossing else [w if w[0] != SPACE or len(w) == 1 or w[1] == SPACE or w == SPACE else w[1:] for w in self._marked(own)]

    def _marked(self, own: str) -> list[str]:
        """The parts of an escaped text; those that do not begin with a space get a mark that they have none."""
        return [w if w[0] == SPACE else _BARE + w for w in _UNIT.findall(own)]

    def _spelled(self, word: str) -> str:
        """A part as the model sees it."""
        if self.crossing:
            return word
        return word[1:] if word[0] == _BARE else word if word[0] == SPACE else SPACE + word

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of whole words, as bytes."""
        by: dict[int, list[int]] = {}
        out: list = [b""] * len(words)
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for size, own in by.items():
            if not size:
                continue
            step = max(1, 400_000 // (size * min(size, self.longest)))
            for a in range(0, len(own), step):
                for k, ids in zip(own[a : a + step], self._rows([words[k] for k in own[a : a + step]])):
                    out[k] = ids
        return out

    def encode(self, texts: list[str | None], cache: dict[str, bytes] | None = None, most: int = 300_000) -> list[bytes]:
        """Ids of whole texts, little-endian unsigned 32-bit. Words that are not cached are encoded once for all texts."""
        cache = {} if cache is None else cache
        split = [self.words(t or "") for t in texts]
        new = set().union(*split) - cache.keys()
        if len(cache) + len(new) > most:
            cache.clear()
            new = set().union(*split)
        new = list(new)
        cache.update(zip(new, self.encode_words([self._spelled(w) for w in new])))
        return [b"".join(map(cache.__getitem__, ws)) for ws in split]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 give U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        raw = self.said[np.repeat(self.starts[ids] - ends + size, size) + np.arange(ends[-1] if len(ids) else 0)].tobytes()
        try:
            text = raw.decode()
            return text[1:] if self.prefix and text.startswith(" ") and not (len(ids) and ids[0] == self.unk) else text
        except UnicodeDecodeError:
            pass
        ids = ids.tolist()
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + k]).decode())
                        i += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            run.clear()

        pieces, bytes_ = self.pieces, self.byte_of
        for i in ids:
            if (b := bytes_.get(i)) is not None:
                run.append(b)
                continue
            if run:
                flush()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(pieces[i])
        if run:
            flush()
        text = "".join(out)
        if self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


_MODELS: dict[str, tuple[Pieces, dict[str, bytes]]] = {}


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """Encodes documents (doc_id, text) and decodes the ids again: doc_id, ids binary, decoded string."""

    def run(batches):
        if model not in _MODELS:
            _MODELS[model] = (Pieces.load(model), {})
        p, cache = _MODELS[model]
        names = ["doc_id", "ids", "decoded", "n_tokens", "ids_crc32", "decoded_sha256", "same"]
        for batch in batches:
            for b in slices(batch, 1, 2_000_000):
                texts = b.column(1).to_pylist()
                own = p.encode(texts, cache)
                back = [p.decode(np.frombuffer(x, "<u4")) for x in own]
                n, crc = [len(x) // 4 for x in own], [zlib.crc32(x) for x in own]
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in back]
                same = [x == (t or "") for x, t in zip(back, texts)]
                cols = [pa.array(own, pa.binary()), pa.array(back, pa.string()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, ids binary, decoded string, n_tokens long, ids_crc32 long, decoded_sha256 string, same boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "same")
