"""Pieces of texts and a bounded cache of what a tokenizer makes of them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

#: A word of letters that every Unicode version calls letters and that NFC leaves alone, and a mark that may end it.
WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: Two of these with a line feed between them: both rules of these vocabularies cut before and after it.
BROKEN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?)\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Uneven(Exception):
    """A piece that is empty or has white space at an end: the text was not cut where the rules cut."""


class Pieces(dict):
    """piece -> what it encodes to, for about ``rows`` pieces at most, in two generations: when the young one is full it
    becomes the old one, and what is met again moves to the young. A value is anything that + puts together. ids makes
    a value of the ids of a lone word; plain makes one of any other text, with the library's own rules. With ``before``,
    pieces stand behind it in their texts; a tuple of a word stands for that word at the start of a line."""

    def __init__(self, path: str, rows: int, before: str, fold: bool, ids: Callable, plain: Callable):
        super().__init__()
        self.rows, self.old, self.before, self.fold, self.ids, self.plain = rows, {}, before, fold, ids, plain
        self.model, self.letters = tokenizer(path).model, byte_letters()
        self.lead = "".join(self.letters[b] for b in before.encode())
        self.marks = {m: plain(m) for m in (".", ",", "\n")}

    def _ids(self, word: str, lead: str = ""):
        word = word.lower() if self.fold else word
        written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return self.ids([t.id for t in self.model.tokenize(lead + written)])

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            if isinstance(piece, tuple):
                value = self.marks["\n"] + self._ids(piece[0])
            elif piece.isalpha() and piece.isascii():
                value = self._ids(piece, self.lead)
            elif found := WORD.fullmatch(piece):
                word, mark = found.groups()
                value = self[word] + self.marks[mark] if mark else self._ids(word, self.lead)
            elif self.before and (not piece or piece[0].isspace() or piece[-1].isspace()):
                raise Uneven
            elif halves := BROKEN.fullmatch(piece):
                first, word, mark = halves.groups()
                line = self[first] + self[(word,)]
                return line + self.marks[mark] if mark else line
            else:
                value = self.plain(self.before + piece)
        if 2 * len(self) >= self.rows:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value
