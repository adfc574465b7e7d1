"""Byte-level BPE over words, with the encoding of a word kept for the next time the worker meets it.

The pattern that splits a text before the merges begins a new piece at each single space between two characters that
aren't white space. So a text is cut there with ``str.split``, each such chunk is encoded once by the library, and its
ids are reused. A text where a chunk is empty, or has white space at its edge, is encoded whole.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import regex

#: Splits text into the pieces within which merges happen. A fixed value of the public vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words and other pieces met since the last turn that a worker keeps, beside as many of the turn before; and the longest kept, in
#: characters. At most 2 * (MAX_WORDS + MAX_PARTS) of some two hundred bytes each are in memory. Results don't depend on them.
MAX_WORDS, MAX_PARTS, MAX_WORD_CHARS = 500_000, 30_000, 32

#: Signs that the pattern takes together, and never apart from each other or with anything else, when they stand behind letters.
STOPS = ".,;:!?*&%$#)]}\"-"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabularies: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Turns(dict):
    """What ``make`` returns for a key, kept for two turns: a full turn becomes the old one, from which keys that are met again come back."""

    def __init__(self, make, most: int) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > MAX_WORD_CHARS:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """``encode(text)``: the ids as little-endian unsigned 16-bit integers. Subclasses say how a piece and a whole text are encoded."""

    def __init__(self, words: int | None = None) -> None:
        self.pieces = regex.compile(PATTERN).findall
        self.mapped = str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})
        self.words = _Turns(self.word_ids, words or MAX_WORDS)
        #: Pieces that aren't a word by themselves, such as stops and what follows a line's end.
        self.parts = _Turns(self.part_ids, MAX_PARTS)

    def piece_ids(self, mapped: str, raw: str) -> list[int]:
        raise NotImplementedError

    def whole_ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def spelled(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", "Ġ")
        return piece.encode().decode("latin-1").translate(self.mapped)

    def part_ids(self, piece: str) -> bytes:
        """Ids of one piece."""
        return array("H", self.piece_ids(self.spelled(piece), piece)).tobytes()

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a chunk, from those of its pieces. Characters past the Latin blocks go to the library's own splitter."""
        if not chunk.isascii() and max(chunk) > "ɏ":
            return array("H", self.whole_ids(chunk)).tobytes()
        pieces = self.pieces(chunk)
        if len(pieces) < 2:
            return self.part_ids(chunk) if pieces else b""
        first = pieces[0]
        if first[0] == " " and first[-1].isalpha():  # a word of its own, which may have been met
            return self.words[first[1:]] + b"".join([self.parts[p] for p in pieces[1:]])
        return b"".join([self.parts[p] for p in pieces])

    def word_ids(self, word: str) -> bytes | None:
        """Ids of a word and the space before it; None if the cut at that space may be wrong."""
        if word.isalpha():  # one piece: letters are what the pattern takes together
            return self.part_ids(" " + word) if word.isascii() or max(word) <= "ɏ" else self.chunk_ids(" " + word)
        core = word.rstrip(STOPS)
        if core.isalpha() and (core.isascii() or max(core) <= "ɏ"):  # two: the letters, and all stops behind them
            return self.words[core] + self.parts[word[len(core) :]]
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return self.chunk_ids(" " + word)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and (first[0].isspace() or first[-1].isspace()):
            return array("H", self.whole_ids(text)).tobytes()
        try:
            return self.chunk_ids(first) + b"".join(map(self.words.__getitem__, rest))
        except TypeError:  # a None among them
            return array("H", self.whole_ids(text)).tobytes()


class LibraryEncoder(WordEncoder):
    """A vocabulary file of the tokenizers library, encoding as it does by default: a text with the string of an added token is encoded whole."""

    def __init__(self, path: str, words: int | None = None) -> None:
        from tokenizers import Tokenizer

        super().__init__(words)
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids over 65535 don't fit two bytes")
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return array("H", self.whole_ids(text)).tobytes()
        return super().encode(text)

    def piece_ids(self, mapped: str, raw: str) -> list[int]:
        return [t.id for t in self.model.tokenize(mapped)]

    def whole_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def library_encoder(path: str, words: int | None = None) -> LibraryEncoder:
    """One for each worker process, so that its words last from task to task."""
    return LibraryEncoder(path, words)


def vocabulary(name: str) -> str:
    """Where the installed public vocabulary file ``name`` is, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
