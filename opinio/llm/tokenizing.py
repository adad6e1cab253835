"""Token ids of the public byte-level BPE vocabularies, fast enough for whole corpora.

The vocabulary never joins characters across a blank that precedes a word, so a text is
cut there and the ids of each cut piece are kept in a table of recent pieces. When it is half
full it becomes the older of two, of which pieces in use move to the new one. Pieces not in it are encoded from the vocabulary's ranks. Texts that contain a special
token's own string go through the tokenizer itself, as its default setting reads them.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: A blank before a word; what either side of it holds is encoded independently.
WORD_START = re.compile(r" (?=\S)")
BLANK_RUN = re.compile(r" \s")

#: Bytes of remembered pieces in a worker, with what the table itself takes for each.
REMEMBERED = 40 << 20
PER_PIECE = 200


def _bytes_of_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for.

    Printable Latin-1 bytes stand for themselves; the others follow from code point 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def little_endian(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        letters = _bytes_of_letters()
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.ranked = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, piece: str) -> bytes:
        return little_endian(self.ranked.encode_ordinary(piece))

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return little_endian(ids)
        first, *words = WORD_START.split(text) if BLANK_RUN.search(text) else text.split(" ")
        if words and not words[-1]:  # a blank at the very end starts no word
            words.pop()
            if words:
                words[-1] += " "
            else:
                first += " "
        if self.held > REMEMBERED // 2:
            self.older, self.known, self.held = self.known, {}, 0
        known = self.known
        for word in set(words).difference(known):
            known[word] = ids = self.older.get(word) or self._ids(" " + word)
            self.held += len(word) + len(ids) + PER_PIECE
        return self._ids(first) + b"".join([known[w] for w in words])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)
