"""Token ids of whole texts, a word at a time.

The vocabulary's tokenizer drops white space and never joins what white space parts,
so a text's ids are its words' ids in a row. Words repeat, so a worker keeps the ids of
those it has met in tables of bounded size and calls the tokenizer for the others. Any
text or word outside the plain range goes through the whole tokenizer unchanged.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import regex

from quern.llm import words as arrow_words

NAME = "word_bpe_49k.json"
_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad\u1680\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_PLAIN = re.compile(r"[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def default_path() -> str:
    """The vocabulary file among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(NAME)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_PACK = [struct.Struct(f"<{n}H").pack for n in range(65)]


class Encoder:
    """Ids as little-endian unsigned 16-bit integers (the vocabulary has under 65,536)."""

    def __init__(self, path: str, words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 65_536:
            raise ValueError("the vocabulary needs wider ids")
        self.tokenize, self.letters = self.whole.model.tokenize, _byte_letters()
        # words and the pieces they are made of, in two generations: when the younger is full it becomes the elder, and what is met again moves up
        self.words, self.old_words, self.most = {}, {}, max(1, words // 2)

    def _full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _keep(self, word: str, found: bytes) -> bytes:
        if len(self.words) >= self.most:
            self.words, self.old_words = {}, self.words
        self.words[word] = found
        return found

    def _made(self, piece: str) -> bytes:
        as_letters = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        ids = [t.id for t in self.tokenize(as_letters)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}H", *ids)

    def _piece(self, piece: str) -> bytes:
        """The ids of a lower-case piece; as a word it has the same."""
        found = self.words.get(piece)
        if found is None:
            found = self._keep(piece, self.old_words.get(piece) or self._made(piece))
        return found

    def _word(self, word: str) -> bytes:
        """The ids of a word that the younger table doesn't have."""
        found = self.old_words.get(word)
        if found is None:
            if "<|" in word or not (word.isascii() and word.isprintable() or _PLAIN.fullmatch(word)):
                found = self._full(word)
            else:
                low = word.lower()
                if low.isalpha():
                    found = self._made(low) if low == word else self._piece(low)
                elif low[:-1].isalpha() and low[-1] in ".,!?;:":
                    found = self._piece(low[:-1]) + self._piece(low[-1])
                else:
                    found = b"".join([self._piece(p) for p in _PIECE.findall(low)])
        return self._keep(word, found)

    def encode(self, text: str) -> bytes:
        """The ids of a text as bytes, without special tokens."""
        if _ODD.search(text):
            return self._full(text)
        words = text.split()
        try:
            return b"".join([self.words[w] for w in words])
        except KeyError:
            get, word = self.words.get, self._word
            return b"".join([word(w) if (x := get(w)) is None else x for w in words])


_ENCODERS: dict[tuple[str, int], Encoder] = arrow_words.kept.setdefault("tokens", {})


def encoder(path: str, words: int = 400_000) -> Encoder:
    """The encoder of this worker process, kept between tasks until another operator's task runs here or one of another size is asked for."""
    arrow_words.give_back("tokens")
    key = path, words
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, words)
    return _ENCODERS[key]
