"""Byte-pair encoding of texts by way of cached pre-tokens.

Texts are cut by the tokenizer's own pre-token pattern; each distinct pre-token
is encoded once by the library and then looked up. Where the pattern's Unicode
classes could differ from the library's (characters outside SAFE) or the
tokenizer is of another kind, the library encodes the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import cached_property
from itertools import islice

import numpy as np
import regex

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on whose classes all Unicode versions in use agree.
UNSAFE = re.compile("[^\x00-՗‐-⁤₠-₿℀-⯿　-鿯가-힣！-～\U0001f300-\U0001f64f]")
#: Entries of a worker's cache beyond the frequent ones; a full cache starts anew.
CACHE = 400_000
#: Longer pre-tokens are encoded each time and never kept.
LONGEST = 64


class Encoder:
    """Looks pre-tokens up in a dict of ``make(ids)`` values, filled by the library."""

    def __init__(self, path: str, make: Callable, frequent: dict | None = None) -> None:
        self.path, self.make, self.frequent = path, make, frequent or {}
        self.table = dict(self.frequent)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        self.special = re.compile("|".join(re.escape(a["content"]) for a in added)) if added else None
        self.find, self.iter = (p := regex.compile(PATTERN)).findall, p.finditer

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, loaded when it is first needed."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        return Tokenizer.from_file(self.path)

    def _special(self, text: str) -> bool:
        return self.special is not None and self.special.search(text) is not None

    def encode(self, texts: list[str], join: Callable) -> list:
        """``join`` of the values of each text's pre-tokens, in order."""
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.plain or self._special(t) or (not t.isascii() and UNSAFE.search(t))]
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False) if whole else [], strict=True):
            out[i] = join([self.make(e.ids)])
        skip, at = set(whole), 0
        while at < len(texts):  # about a million characters at a time
            end, size = at, 0
            while end < len(texts) and size < 1 << 20:
                size += len(texts[end])
                end += 1
            if size < 1 << 22:
                cut = {i: self.find(texts[i]) for i in range(at, end) if i not in skip}
                for i, value in zip(cut, self._values(list(cut.values()), join), strict=True):
                    out[i] = value
            else:
                for i in range(at, end):
                    if i not in skip:
                        out[i] = join([self._values([part], join)[0] for part in self._parts(texts[i])])
            at = end
        return out

    def _parts(self, text: str):
        found = (m.group() for m in self.iter(text))
        while part := list(islice(found, 200_000)):
            yield part

    def _values(self, cut: list[list[str]], join: Callable) -> list:
        if len(self.table) > len(self.frequent) + CACHE:
            self.table = dict(self.frequent)
        pieces = list(set().union(*cut).difference(self.table))
        for piece, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False) if pieces else [], strict=True):
            self.table[piece] = self.make(e.ids)
        get = self.table.__getitem__
        out = [join(map(get, x)) for x in cut]
        for piece in pieces:
            if len(piece) > LONGEST:
                del self.table[piece]
        return out


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class FastIds:
    """Ids of whole texts as NumPy arrays, the same as the tokenizer library's.

    A byte-level vocabulary whose merges come in the order of their ids is a rank
    table, which tiktoken applies several times faster. Texts with characters
    outside SAFE, and other vocabularies, go to the library itself.
    """

    def __init__(self, path: str) -> None:
        self.own = Encoder(path, len)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec.get("added_tokens") or [])])
        self.ranks = self._ranks(spec) if self.own.plain else None

    def _ranks(self, spec: dict):
        import tiktoken

        model, letters = spec["model"], _byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        if model.get("type", "BPE") != "BPE" or made != sorted(set(made)) or (made and made[0] < 0) or model.get("ignore_merges"):
            return None
        special = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        slow = [i for i, t in enumerate(texts) if self.ranks is None or (not t.isascii() and UNSAFE.search(t))]
        out = [None] * len(texts)
        for i, e in zip(slow, self.own.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False) if slow else [], strict=True):
            out[i] = np.array(e.ids, "<u4")
        return [self.ranks.encode_to_numpy(t, allowed_special="all") if x is None else x for t, x in zip(texts, out, strict=True)]
