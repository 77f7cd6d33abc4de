"""Byte-level BPE vocabulary files and the cutting of texts into independent chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Fixed: the word pattern of byte-level vocabularies of this kind.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = regex.compile(WORD_PATTERN)

# A space before anything but white space always begins a new word, so texts can be cut there
# and equal chunks give equal words wherever they stand.
CHUNK_START = re.compile(r"(?= \S)")

LONGEST_KEPT = 64  # characters of a chunk worth remembering
SLICE_BYTES = 4 << 20


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    spare = 256
    for b in range(256):
        if b not in letters.values():
            letters[chr(spare)] = b
            spare += 1
    return letters


class Vocabulary:
    """A byte-level BPE file (``.json`` of the tokenizers library): merges as numbers, tokens as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE vocabulary without normaliser")
        if spec["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("prefix spaces, ignored merges and dropout are not supported")
        self.specials: dict[str, int] = {}
        for token in spec.get("added_tokens", []):
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError("added tokens that take neighbours are not supported")
            self.specials[token["content"]] = token["id"]
        letters = byte_letters()
        ids: dict[str, int] = model["vocab"]
        self.token_bytes: dict[int, bytes] = {
            i: bytes(letters[c] for c in token) for token, i in ids.items() if token not in self.specials
        } | {i: token.encode() for token, i in self.specials.items()}
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        self.base = max(self.token_bytes) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: left * base + right of every mergeable pair, in rank order, and what the pair becomes
        self.pair_keys = np.array([ids[a] * self.base + ids[b] for a, b in merges], np.int64)
        self.pair_ids = np.array([ids[a + b] for a, b in merges], np.int64)
        longest_first = sorted(self.specials, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which are kept as segments of their own."""
        if self._special is None or not any(s in text for s in self.specials):
            return [text]
        return [s for s in self._special.split(text) if s]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One copy per Python worker."""
    return Vocabulary(path)


def cut_words(chunk: str) -> list[str]:
    """The words of a chunk; the two commonest forms are told without the pattern."""
    body = chunk[1:] if chunk[:1] == " " else chunk
    if body.isalpha():
        return [chunk]
    if body[-1:] in (".", ",") and body[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return WORDS.findall(chunk)


class ChunkMemory:
    """What each chunk of text becomes, worked out once per distinct word and remembered.

    ``solve`` turns a list of distinct words into their values, ``join`` puts the values of a
    chunk's words together. Memory is bounded: there are two generations of at most ``most`` chunks and
    words each and what the last slice of texts needed; what neither holds is worked out again. Long
    chunks are not kept beyond their slice.
    """

    def __init__(self, specials: dict[str, object], solve: Callable, join: Callable, most: int = 350_000):
        self.specials, self.solve, self.join, self.most = specials, solve, join, most
        self.known: dict[str, object] = dict(specials)  # no other chunk can equal a special string
        self.older: dict[str, object] = {}

    def _recall(self, wanted: set[str]) -> list[str]:
        """Those not known yet, after taking over what the older generation has."""
        missing = []
        known, older = self.known, self.older.get
        for chunk in wanted.difference(known):
            value = older(chunk)
            if value is None:
                missing.append(chunk)
            else:
                known[chunk] = value
        return missing

    def learn(self, texts: list[list[str]]) -> dict[str, object]:
        """Make every chunk of these texts known; returns the values by chunk."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, dict(self.specials)
        wanted: set[str] = set()
        for chunks in texts:
            wanted.update(chunks)
        missing = self._recall(wanted)
        parted = [(c, w) for c, w in zip(missing, map(cut_words, missing)) if len(w) != 1]
        single = set(missing).difference(c for c, _ in parted)
        unknown = [*single, *self._recall({w for _, words in parted for w in words}.difference(single))]
        self.known.update(zip(unknown, self.solve(unknown)))
        value = self.known.__getitem__
        self.known.update([(c, self.join(map(value, words))) for c, words in parted])
        found = self.known
        lengthy = [c for c in (*missing, *unknown) if len(c) > LONGEST_KEPT]
        if lengthy:
            self.known = dict(found)
            for c in lengthy:
                self.known.pop(c, None)
        return found

    def values(self, vocab: Vocabulary, texts: list[str]) -> Iterator[list]:
        """For each text the list of its chunks' values in order."""
        cut = []
        for text in texts:
            segments = vocab.segments(text)
            if len(segments) == 1 and text not in self.specials:
                cut.append(CHUNK_START.split(text))
                continue
            parts: list[str] = []
            for segment in segments:
                parts.extend([segment] if segment in self.specials else CHUNK_START.split(segment))
            cut.append(parts)
        found = self.learn(cut)
        for parts in cut:
            yield list(map(found.__getitem__, parts))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of an array of texts of about ``most`` bytes each."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    parts = ends // most
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)]
    for low, high in zip(cuts, cuts[1:]):
        yield texts.slice(low, high - low)
