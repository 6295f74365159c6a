"""Texts to token ids with a tokenizer whose pre-tokenizer never joins across white space.

Such a tokenizer gives a text the ids of its words, one after the other, so each distinct word is
encoded by the library once a task and then looked up; so is each distinct piece that the library's
pre-tokenizer cuts words into. Tests hold the ids against whole texts.
"""

from __future__ import annotations

import re

import public_tokenizers

from .common import keep_only

END_ID = 1
#: Words, and pieces, kept in a worker's memory; beyond it a table starts anew. Both stay below two thirds of a power of
#: two, where a dict would double. Longer words are encoded each time.
CACHED_WORDS, CACHED_PIECES = 690_000, 345_000
CACHED_BYTES = 64
#: As many where a worker's memory is shared with what other stages left in it.
FEWER_WORDS = 172_000

# Fixed value: how the tokenizer's pre-tokenizer cuts ASCII text, lower-cased.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class Pieces(dict):
    """pre-tokenized piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model):
        super().__init__()
        self.model, self.most = model, CACHED_PIECES

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(piece))
        if len(piece) <= CACHED_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class Encoder(dict):
    """word (UTF-8 bytes) -> its ids as little-endian unsigned 32-bit integers."""

    made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(self.tokenizer.model)
        self.end = END_ID.to_bytes(4, "little")
        self.plain, self.most = path == default_path(), CACHED_WORDS

    @classmethod
    def at(cls, path: str, words: int = CACHED_WORDS) -> Encoder:
        """The worker's encoder for a file: read once, kept between tasks; it keeps so many words, and half as many pieces."""
        if path not in cls.made:
            cls.made[path] = cls(path)
        found = cls.made[path]
        found.most, found.pieces.most = words, min(CACHED_PIECES, words // 2)
        keep_only(found, found.pieces)
        return found

    def cut(self, word: bytes) -> list[str]:
        """The pieces that the tokenizer cuts a word into."""
        if self.plain and word.isascii() and word.isalpha():
            return [word.decode().lower()]
        if self.plain and word.isascii() and word.decode().isprintable():
            return ASCII_PIECES.findall(word.decode().lower())
        normal = self.tokenizer.normalizer.normalize_str(word.decode()) if self.tokenizer.normalizer else word.decode()
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def __missing__(self, word: bytes) -> bytes:
        if b"<|" in word or len(word) > CACHED_BYTES:  # may hold a special token; long words take the library's own way
            ids = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        else:
            ids = b"".join(map(self.pieces.__getitem__, self.cut(word)))
        if len(word) <= CACHED_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a text, with END_ID after them."""
        return b"".join(map(self.__getitem__, (text or b"").split())) + self.end


def vocabulary_size(path: str) -> int:
    return Encoder.at(path).tokenizer.get_vocab_size()
