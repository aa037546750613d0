"""Token ids of whole texts with the word-level BPE, through a bounded cache of words.

The tokenizer's normaliser and pre-tokenizer never join what white space separates, so a text's ids are its words' ids one
after the other. Texts beyond Latin-1, where lower-casing may depend on neighbours, go to the tokenizer whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers at most.
CACHE_WORDS = 1_200_000
_CUT = "\x01"
_ODD = re.compile("[\x01\x1c-\x1f<]")
#: Before such a mark ends a pre-token, unless another mark stands before it: a space there changes no id, and words recur more often without marks.
_MARKS = b".,!?;:%*&$#|"
_MARK = re.compile(rb"(?<=[a-z\xdf-\xf6\xf8-\xff])(?=[.,!?;:%*&$#|])")
_PAIR = re.compile(rb"[!-/:-@\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7]{2}")


def _parted(text: bytes) -> list[bytes]:
    """The words of a lower-case text in Latin-1, with marks parted from the letters before them."""
    if _PAIR.search(text):
        return _MARK.sub(b" ", text).split()
    for i in range(len(_MARKS)):
        mark = _MARKS[i : i + 1]
        if mark in text:
            text = text.replace(mark, b" " + mark)
    return text.split()


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies spell bytes: printable ones themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_SPELL = _byte_letters()


class TokenCache:
    def __init__(self, path: str | None = None):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.bare = Tokenizer(self.tokenizer.model)  # for words of letters alone: no rules to apply, only merges
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.cut = self._whole(_CUT)[0]
        self.words: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[bytes], tokenizer: Tokenizer, text: str) -> None:
        """One call for all new words: an id that no word has marks where each ends."""
        raw = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(raw == self.cut) * 4
        data = raw.tobytes()
        lo = [0, *(ends + 4).tolist()]
        hi = [*ends.tolist(), len(data)]
        self.words.update(zip(new, [data[i:j] for i, j in zip(lo, hi, strict=True)], strict=True))

    def learn(self, new: list[bytes]) -> None:
        text = {w: w.decode("latin-1") for w in new}
        plain = [w for w in new if text[w].isalpha()]
        mixed = [w for w in new if not text[w].isalpha()]
        if plain:
            spelled = "\n".join(map(text.__getitem__, plain)).encode().decode("latin-1").translate(_SPELL | {10: f" {_CUT.translate(_SPELL)} "})
            self._learn(plain, self.bare, spelled)
        if mixed:
            self._learn(mixed, self.tokenizer, f" {_CUT} ".join(map(text.__getitem__, mixed)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        split: list[list[bytes] | None] = []
        for x in texts:
            if not x:
                split.append([])
            elif _ODD.search(x):
                split.append(None)
            else:
                try:
                    split.append(_parted(x.lower().encode("latin-1")))
                except UnicodeEncodeError:
                    split.append(None)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known = self.words
        new = list(set().union(*(s for s in split if s)).difference(known))
        if new:
            self.learn(new)
        return [b"".join(map(known.__getitem__, s)) if s is not None else np.array(self._whole(x), "<u4").tobytes() for s, x in zip(split, texts, strict=True)]


_CACHES: dict[str | None, TokenCache] = {}


def cache(path: str | None = None) -> TokenCache:
    """This worker's cache for the vocabulary file at ``path``."""
    if path not in _CACHES:
        _CACHES[path] = TokenCache(path)
    return _CACHES[path]


@contextmanager
def task_cache(path: str | None = None) -> Iterator[TokenCache]:
    """This worker's cache for one task: the words go when it ends, for the worker lives on and serves other queries."""
    found = cache(path)
    try:
        yield found
    finally:
        found.words.clear()
