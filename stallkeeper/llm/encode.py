"""Whole texts to token ids with the tokenizers library, each distinct word encoded once by a task.

Both public vocabularies cut a text before a space that a non-space follows, whatever stands around it. So such pieces can
be encoded alone and their ids joined; a cache of pieces makes that several times faster than encoding whole texts. Where
the vocabulary allows it (see `Encoder._fold`), a new piece of Latin-1 letters and signs is given to the model as letters and
signs, without the steps before it. A text where a space is followed by white space or the end is encoded as a whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import cache

from tokenizers import Tokenizer

#: Bytes of pieces that a worker remembers at most, counting PIECE_BYTES beside the text and ids of each.
CACHE_BYTES, PIECE_BYTES = 80 << 20, 160
_UNSAFE = re.compile(r" (?:\s|$)")
_CODES = {2: "H", 4: "I"}
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&()*+,./:;=?@^_~-]*)")
_LETTERS = "".join(c for c in map(chr, range(65, 256)) if _PLAIN.fullmatch(c))
_PROBES = ("the", "THE", "Jumps", "quickBrownFoxes", "xyzzyJKLMNOP", _LETTERS, _LETTERS[::-1], _LETTERS[::2] + _LETTERS[1::2])
#: Bytes as byte-level vocabularies write them: visible Latin-1 characters stand for themselves, the others for U+0100 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


@cache
def encoder(path: str, spaced: bool, width: int) -> Encoder:
    return Encoder(path, spaced, width)


class _Pieces(dict):
    """Ids by piece; those of a missing one are asked for once."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self.ask = ask

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.ask(piece)
        return ids


class Encoder:
    """`spaced`: pieces keep the space before them (byte-level vocabularies); `width`: bytes of an id, little-endian."""

    def __init__(self, path: str, spaced: bool, width: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced, self.kind, self.width = spaced, _CODES[width], width
        # Pieces used since the last turn, and those of the turn before; frequent ones move over, the others are forgotten.
        self.known, self.before = _Pieces(self._ask), {}
        self.size = 0
        self.fold = self._fold()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def _letters(self, word: str, fold: Callable[[str], str]) -> list[int]:
        """Ids of letters, for a spaced vocabulary with a space before them."""
        text = fold(word)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(_BYTES)
        return [token.id for token in self.model.tokenize(_BYTES[32] + text if self.spaced else text)]

    def _fold(self) -> Callable[[str], str] | None:
        """What a byte-level vocabulary does to letters before its model: nothing or lower case. None if the ids of some letters
        show that neither holds, if signs do not end a word, or if it has whole words that it cuts texts at."""
        if any(t.content.strip().isalpha() for t in self.tokenizer.get_added_tokens_decoder().values()):
            return None
        space = " " * self.spaced
        ended, word, sign = self._plain([f"{space}word,", f"{space}word", ","])
        whole = self._plain([space + word for word in _PROBES])
        if ended != word + sign:
            return None
        return next((fold for fold in (str, str.lower) if [self._letters(word, fold) for word in _PROBES] == whole), None)

    def _ask(self, piece: str) -> bytes:
        ids = self.before.pop(piece, None)
        if ids is None:
            parts = self.fold and (piece[:1] == " " or not self.spaced) and _PLAIN.fullmatch(piece, int(self.spaced))
            if parts:
                ids = self._bytes(self._letters(parts[1], self.fold)) + (self.known[parts[2]] if parts[2] else b"")
            else:
                ids = self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        self.size += PIECE_BYTES + len(piece) + len(ids)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, joined as little-endian integers."""
        if self.size > CACHE_BYTES // 2:
            self.known, self.before, self.size = _Pieces(self._ask), self.known, 0
        split = (lambda t: t.replace(" ", "\0 ").split("\0")) if self.spaced else (lambda t: t.split(" "))
        cut = [None if "\0" in text or _UNSAFE.search(text) else split(text) for text in texts]
        whole = iter(self._plain([t for t, pieces in zip(texts, cut, strict=True) if pieces is None]))
        get = self.known.__getitem__
        return [self._bytes(next(whole)) if pieces is None else b"".join(map(get, pieces)) for pieces in cut]
