"""Token ids of whole texts by a public tokenizer file, as little-endian uint32 bytes.

The vocabulary drops white space and never joins across it, so the ids of a text are the
ids of its white-space separated chunks, one after the other. Each distinct chunk is
encoded once by the tokenizers library and then looked up; a text costs a split and a
lookup per chunk. ``WordEncoder`` checks at start that the tokenizer is of that kind
and otherwise encodes whole texts.
"""

from __future__ import annotations

import os
import re
import struct

#: Strings that a task remembers at most (about 200 bytes each): those of a young and
#: of an old generation. When the young one is full it becomes the old one.
CACHE_STRINGS = 800_000
#: Letters that the normal form of a text leaves as they are, alone and side by side.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
_ENDS_PLAIN = re.compile(rb"(?s:.*)(?:[0-9a-z]|\xc3[\x9f-\xb6\xb8-\xbf])").fullmatch

_encoders: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the others for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordEncoder(dict):
    """Maps a chunk (UTF-8 bytes without white space) to the bytes of its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(_byte_letters())})
        self.specials = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        shared = set.intersection(*map(set, self.specials)) if self.specials else set()
        self.mark = bytes([min(shared)]) if shared else b""  # in every special token, so rarely looked for
        self.old: dict[bytes, bytes] = {}
        probe = "a  b\tc\n" + "thing, THING. l'été 42nd"
        self.pure_words = all(self.pure(w) == self.whole(w) for w in ("thing", "été", "straße"))
        self.by_word = self.whole(probe) == self.by_chunk(probe)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def pure(self, word: str) -> bytes | None:
        """Ids of a word of letters only: the model is asked directly, as such a word is
        one piece for the splitter. None if its normal form has other characters."""
        if not _PLAIN(word):
            word = self.tokenizer.normalizer.normalize_str(word)
            if not word.isalpha():
                return None
        marks = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model(marks)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            low = chunk.lower()  # A-Z only, as these are bytes
            core = low.rstrip(b".,!?;:%$&*#")  # no part of a special token's end
            if self.mark in low and any(s in low for s in self.specials):  # they match the text as it stands, before its case is folded
                ids = self.whole(chunk.decode())
            elif len(core) < len(low) and _ENDS_PLAIN(core):  # marks and signs would stay one piece
                ids = self[core] + self[low[len(core) :]]
            elif low != chunk:
                ids = self[low]
            else:
                word = chunk.decode()
                ids = self.pure(word) if self.pure_words and word.isalpha() else None
                ids = self.whole(word) if ids is None else ids
        self[chunk] = ids
        return ids

    def by_chunk(self, text: str) -> bytes:
        if len(self) > CACHE_STRINGS // 2:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.encode().split()))

    def forget(self) -> None:
        """Called at a task's end, as its process lives on."""
        self.clear()
        self.old = {}

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text (null: none)."""
        if not text:
            return b""
        return self.by_chunk(text) if self.by_word else self.whole(text)


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
