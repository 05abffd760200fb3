"""Ids of texts by public tokenizers, with results per word kept between texts.

A text is cut where no token can reach across (white space), so the ids of a text are those of its parts, one after the
other. What a part gives is kept in a bounded cache of the worker; a part of letters and closing marks is cut once more,
since `word` and `word,` share most of their work. Texts for which this does not hold are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import kept

#: Entries of a generation of a cache; a worker keeps two generations. This bounds its memory, not its results.
KEPT = 250_000
_MARKS = b".,!?;:*#$%&|"
_SPACES = b" \t\n\r\x0b\x0c"
# White space beyond ASCII, and separators that only some of the libraries count as such.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -​    　]")
_RUNS = (b"\t", b"\r", b"\x0b", b"\x0c", b"\0", b"  ", b"\n\n", b" \n", b"\n ")
_SPACED = re.compile(rb"[ \t\n\r\x0b\x0c]+[^ \t\n\r\x0b\x0c]*|[^ \t\n\r\x0b\x0c]+")


class Recent(dict):
    """What `make` gives for a key, kept for the keys of late: a full generation becomes the old one, which keys in use leave."""

    def __init__(self, make, kept: int = KEPT):
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Encodes texts to little-endian ids of `width` bytes each.

    lower: the vocabulary folds case and drops white space (word_bpe); otherwise white space belongs to what follows it.
    """

    def __init__(self, path: str, lower: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.lower = self.tokenizer.model, lower
        # Strings of special tokens in a text are encoded as the library does it by default.
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        # Where case is kept, a part without marks is its own stem: one cache has the room of two.
        self.parts, self.stems = Recent(self._part, KEPT if lower else 2 * KEPT), Recent(self._stem)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _stem(self, stem: str) -> bytes:
        """One run of letters, with a space before it where that belongs to it: the model alone can merge it."""
        shown = stem
        if not stem.isascii():
            shown = stem.encode().decode("latin-1").translate(_SHOWN)
        elif stem[:1] == " ":
            shown = _SPACE + stem[1:]
        return array(self.code, [p.id for p in self.model.tokenize(shown)]).tobytes()

    def _part(self, part: bytes) -> bytes:
        if self.lower:
            part = part.lower()
        elif part[:1] == b"\n" and part[1:].strip(_SPACES) == part[1:] != b"":  # a line end before a word is a token of its own
            return self.parts[b"\n"] + self.parts[part[1:]]
        stem = part.rstrip(_MARKS)
        text = stem.decode("utf-8", "replace")
        if self.lower and not text.isascii():
            text = self.tokenizer.normalizer.normalize_str(text)
        if len(text) < 200 and text[text[:1] == " ":].isalpha():
            if len(stem) < len(part):
                return (self.stems[text] if self.lower else self.parts[stem]) + self.parts[part[len(stem):]]
            return self.stems[text] if self.lower else self._stem(text)  # where case is kept, a part and its stem are the same
        return self._whole(part.decode("utf-8", "replace"))

    def ids(self, text: bytes) -> bytes:
        """The ids of a whole text, as bytes."""
        if any(s in text for s in self.specials) or (not text.isascii() and _ODD_SPACE.search(text.decode("utf-8", "replace"))) or _CONTROL.search(text):
            return self._whole(text.decode("utf-8", "replace"))
        if self.lower:
            parts = text.split()
        elif any(run in text for run in _RUNS):
            parts = _SPACED.findall(text)
        else:  # single blanks and line ends only: each begins a part
            parts = text.replace(b" ", b"\0 ").replace(b"\n", b"\0\n").split(b"\0")
        return b"".join(map(self.parts.__getitem__, parts))


# How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SPACE = chr(_SHOWN[0x20])
_CONTROL = re.compile(rb"[\x1c-\x1f]")


def encoder(path: str, lower: bool) -> Encoder:
    """The encoder that this worker keeps."""
    return kept(("encoder", path, lower), lambda: Encoder(path, lower))


def wide(ids: bytes, width: int) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
