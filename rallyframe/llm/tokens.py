"""Ids of whole texts by a byte-level tokenizers file, piece by piece.

A byte-level tokenizer with this splitting rule encodes each piece apart from the others, and
pieces repeat far more than texts do: each worker keeps the ids of those it has met (up to
PIECES_KEPT, then it starts anew), and only new pieces go to the library. The strings of the
file's special tokens are pieces of their own, found before all else. Texts of Latin-1 are
cut by the rule itself. In others a run of white space always begins a new piece
when it follows something else, so they are cut before each such run; those with a character
whose class differs between the two notions of white space are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

#: Contractions of the splitting rule, and Latin-1's letters, numbers and white space.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"

PIECES_KEPT = 1_000_000
GROUP = 64
BEYOND_LATIN = re.compile("[^\x00-\xff]")
PIECE = re.compile(f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
UNIT = re.compile(r"\s*\S+|\s+")
UNSURE = re.compile("[\x1c-\x1f\x85᠎​-‏ - ⁠-⁤﻿]")


class PieceEncoder:
    """Encodes texts as the tokenizers library does; a special token's string stands for its id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        contents = sorted((re.escape(x.content) for x in added), key=len, reverse=True)
        self.special_split = re.compile(f"({'|'.join(contents)})") if contents else None
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native (little-endian) unsigned 32-bit integers; GROUP texts are cut at a time."""
        return [ids for k in range(0, len(texts), GROUP) for ids in self._encoded(texts[k : k + GROUP])]

    def pieces(self, text: str) -> list[str]:
        if not self.special_split or not self.special_split.search(text):
            return self.plain_pieces(text)
        parts = self.special_split.split(text)
        return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else self.plain_pieces(part))]

    @staticmethod
    def plain_pieces(text: str) -> list[str]:
        if not BEYOND_LATIN.search(text):
            return PIECE.findall(text)
        return [text] if UNSURE.search(text) else UNIT.findall(text)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        known = self.known
        split = [self.pieces(text) for text in texts]
        new = set().union(*split).difference(known)
        if len(known) + len(new) > PIECES_KEPT:
            known.clear()
            new = set().union(*split)
        if new:
            listed = list(new)
            known.update(zip(listed, self._whole(listed), strict=True))
        return [b"".join(map(known.__getitem__, x)) for x in split]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
