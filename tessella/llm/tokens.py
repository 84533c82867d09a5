"""Tokenizer access shared by packing and token output: whole texts to the ids that the tokenizers library gives.

The vocabulary and merges come from the tokenizers file; tiktoken's merge loop runs over them, which takes a third of the
time. It merges by rank of the result, so the ids are the library's only if merges stand in the order of their results' ids: that is
checked when a file is loaded, as are the ids of PROBES strings against the library; a file that fails raises. Where a tokenizer
drops white space, words are encoded once each and kept in a bounded cache. Texts with the tokenizer's special strings or
unusual white space go through the tokenizers library itself. ``tests/llm`` holds the ids of texts against that library.
"""

from __future__ import annotations

import json
import os
import random
import re
from array import array
from unicodedata import normalize

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_BYTE_LEVEL = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
_ASCII = re.compile("[a-z]+|[0-9]|[^\\sa-z0-9]+")  # what the pattern of words does on lower-case ASCII without apostrophes
_NEWER = "\u1c80"  # from here on, Python and the library may know different cases
PROBES = 400
_ODD = re.compile("[\x1c-\x1f\x85᠎​﻿]|<\\|")


def _byte_chars() -> dict[str, int]:
    """The printable characters that byte-level vocabularies use for bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextCoder:
    """Encodes texts with a tokenizers file of byte-level BPE (with or without word ends)."""

    def __init__(self, path: str, cache: int = 300_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.whole = Tokenizer.from_file(path)
        self.end = (spec["model"].get("end_of_word_suffix") or "")
        special = {x["content"] for x in spec.get("added_tokens", [])}
        chars = _byte_chars()
        tail = "</w>" if self.end else None
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token in special:
                continue
            last = b""
            if tail and token.endswith(tail):
                token, last = token[: -len(tail)], b"\xff"  # no UTF-8 text holds this byte
            ranks[bytes(chars[c] for c in token) + last] = i
        pre = spec["pre_tokenizer"]
        self.words = bool(self.end)
        pattern = _BYTE_LEVEL
        if self.words:
            pattern = next(x for x in pre["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.merge, self.numpy = own._core_bpe.encode_single_piece, own.encode_to_numpy
        self.pieces = regex.compile(pattern).findall
        self.vocab = self.whole.get_vocab_size(with_added_tokens=True)
        self.most = cache
        self.cache: dict[str, bytes] = {}
        self._check(spec["model"]["merges"], spec["model"]["vocab"], special)

    def _check(self, merges: list, vocab: dict[str, int], special: set[str]) -> None:
        """Raises where rank order is not the order of merges, or a probe's ids are not the library's."""
        results = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if any(a >= b for a, b in zip(results, results[1:])):
            raise ValueError("the merges do not stand in the order of their results' ids")
        r = random.Random(9)
        own = [t.replace("</w>", "").replace("Ġ", " ") for t in vocab if t not in special]
        probes = ["".join(r.choice(own) + r.choice(["", "", " ", "é", "\n", "7", "'s "]) for _ in range(6)) for _ in range(PROBES)]
        if [np.frombuffer(self.encode(t), "<u4").tolist() for t in probes] != [e.ids for e in self.whole.encode_batch(probes, add_special_tokens=False)]:
            raise ValueError("this tokenizer's ids are not those of merges by rank")

    def _words(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks between white space."""
        flat: list[int] = []
        ends = [0]
        merge, own, normal = self.merge, _ASCII.findall, self.whole.normalizer.normalize_str
        for chunk in chunks:
            plain = chunk.isascii()
            text = chunk.lower() if plain else normal(chunk) if max(chunk) >= _NEWER or "Σ" in chunk or "İ" in chunk else normalize("NFC", chunk).lower()
            for p in own(text) if plain and "'" not in text else self.pieces(text):
                flat += merge(p.encode() + b"\xff")
            ends.append(4 * len(flat))
        data = array("I", flat).tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; null counts as empty."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """encode() of several texts; their words that are not cached are encoded once."""
        odd = [bool(t) and bool(_ODD.search(t)) for t in texts]
        if self.words:
            split = [[] if o or not t else t.split() for t, o in zip(texts, odd)]
            new = set().union(*split) - self.cache.keys()
            if len(self.cache) + len(new) > self.most:
                self.cache.clear()
                new = set().union(*split)
            new = list(new)
            self.cache.update(zip(new, self._words(new)))
            out = [b"".join(map(self.cache.__getitem__, ws)) for ws in split]
        else:
            out = [b"" if o or not t else self.numpy(t, disallowed_special=()).astype("<u4").tobytes() for t, o in zip(texts, odd)]
        for k, o in enumerate(odd):
            if o:
                out[k] = array("I", self.whole.encode(texts[k], add_special_tokens=False).ids).tobytes()
        return out


_CODERS: dict[str, TextCoder] = {}


def coder(path: str) -> TextCoder:
    """One coder for each file and Python worker."""
    if path not in _CODERS:
        _CODERS[path] = TextCoder(path)
    return _CODERS[path]
