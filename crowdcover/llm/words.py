"""Texts cut into chunks that are encoded one by one, so that a chunk's ids can be remembered."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np

#: Chunks of one generation that a worker remembers, about 150 bytes each; there are two. Beyond that
#: it forgets those not met for longest.
REMEMBERED = 200_000
#: Letters of the longest chunk that is remembered; longer ones are encoded every time.
LONGEST = 40
#: Characters of the texts that are cut together, and chunks that are encoded together. A longer text is
#: cut alone.
TOGETHER, AT_ONCE = 1_000_000, 4_000

#: A comma or full stop that does not simply end a word: no letter before it, or something else
#: than a letter, a space, a line end or the text's end behind it.
_ODD_STOP = re.compile(r"[,.](?:(?<![A-Za-z0-9À-ÖØ-öø-ÿ][,.])|(?![A-Za-z0-9À-ÖØ-öø-ÿ \n]|\Z))")


class Recent:
    """chunk -> value, for chunks that are made many at a time: ``missing`` tells which to make, ``of``
    gives the values of a text's chunks, ``add`` remembers what was made. When a generation is full it
    becomes the older one, and what is met again moves into the next; the rest goes."""

    def __init__(self, room: int = REMEMBERED):
        self.room, self.now, self.older = room, {}, {}

    def missing(self, texts: list[list[str]]) -> list[str]:
        out = []
        for chunk in set(filterfalse(self.now.__contains__, chain.from_iterable(texts))):
            if chunk in self.older:
                self.now[chunk] = self.older[chunk]
            else:
                out.append(chunk)
        return out

    def of(self, chunks: list[str], made: dict) -> list:
        found = list(map(self.now.get, chunks))
        return [made[c] if v is None else v for c, v in zip(chunks, found)] if None in found else found

    def add(self, made: dict) -> None:
        self.now.update((c, v) for c, v in made.items() if v is not None)
        if len(self.now) > self.room:
            self.older, self.now = self.now, {}


def stops_end_words(text: str) -> bool:
    return not _ODD_STOP.search(text)


def single_blanks(text: str) -> bool:
    """All white space is one space or one line end between two words."""
    words, blanks = text.split(), text.count(" ") + text.count("\n")
    return len(words) == blanks + 1 and sum(map(len, words)) + blanks == len(text)


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker; what it remembers serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    """Ids of a tokenizer that drops white space, as little-endian 32-bit numbers.

    No token spans white space, so a text is encoded by chunks between spaces. Of the chunks of some
    texts that are not remembered, those of Latin letters go straight to the merges; the others go
    through the tokenizer together, with a space between them, and the place where a token starts tells
    its chunk. Texts that may hold a special token, also one in capitals, are not cut. Equal to the
    tokenizer's own ids (tests).
    """

    _letters = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        from array import array

        from tokenizers import Tokenizer

        self.array = array
        # the printable stand-in of a byte: itself, or the next free code point from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.stand_in = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowered = [s.lower() for s in self.special]
        self.known = Recent()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters_only(self, chunk: str) -> bytes:
        shown = "".join(map(self.stand_in.__getitem__, chunk.lower().encode()))
        return self.array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _made(self, chunks: list[str]) -> dict[str, bytes]:
        out, others = {}, []
        for chunk in chunks:
            if self._letters.fullmatch(chunk):
                out[chunk] = self._letters_only(chunk)
            elif len(chunk) > LONGEST:
                out[chunk] = self._whole(chunk)
            else:
                others.append(chunk)
        for i in range(0, len(others), AT_ONCE):
            group = others[i:i + AT_ONCE]
            found = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            starts = np.array([start for start, _ in found.offsets], np.int64)
            ends = np.searchsorted(starts, np.cumsum([len(c) + 1 for c in group])).tolist()
            ids, at = np.array(found.ids, "<u4").tobytes(), 0
            for chunk, end in zip(group, ends):
                out[chunk] = ids[4 * at:4 * end]
                at = end
        return out

    def _chunks(self, text: str) -> list[str] | None:
        """What is encoded piece by piece; None if the text has to be encoded as a whole."""
        lower = text.lower()
        if any(s in lower for s in self.lowered) or any(s in text for s in self.special):
            return None
        stops = stops_end_words(text)
        try:
            text.encode("latin-1")
            text = lower  # letter by letter here, so a chunk in capitals is no chunk of its own
        except UnicodeEncodeError:
            pass
        if stops:
            text = text.replace(",", " ,").replace(".", " .")
        return text.replace("\n", " ").split(" ")

    def _block(self, texts: list[str]) -> list[bytes]:
        cut = [self._chunks(t) for t in texts]
        now = self.known.now
        made = self._made(self.known.missing([c for c in cut if c is not None]))
        now.update(made)
        out = [self._whole(t) if chunks is None else b"".join(map(now.__getitem__, chunks))
               for t, chunks in zip(texts, cut)]
        for chunk in made:
            if len(chunk) > LONGEST:
                del now[chunk]
        self.known.add({})
        return out

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text, in order."""
        block, size = [], 0
        for text in texts:
            if block and size + len(text) > TOGETHER:
                yield from self._block(block)
                block, size = [], 0
            block.append(text)
            size += len(text)
        if block:
            yield from self._block(block)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))
