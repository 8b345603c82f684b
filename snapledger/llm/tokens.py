"""Token ids of texts by a public vocabulary file, fast enough for whole corpora."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

#: Pieces whose ids are remembered in a worker (about 200 bytes each); the memory is emptied when it is full.
REMEMBERED = 300_000
#: Characters of text that are looked through for new pieces at once.
AHEAD = 1 << 20
#: Marks between a letter and white space are a token group of their own.
_MARKS = re.compile(r"([.,;:!?|#$%&*](?<=[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF].)[.,;:!?|#$%&*]*)(?=[ \n\t\r]|\Z)")
#: Texts on which a vocabulary must give the ids of whole texts from pieces, or else every text is encoded whole.
_PROBES = ("The quick-brown fox, isn't it? 12,5 ABC", "a  b\tc\nd", "x.y,z !?. é ÀÉ ß, don't I'll 3.14.", "tion, end.", " lead and trail ", "ab12cd, e5. #tag", "中文 字, 한글.")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, as ``encode(text, add_special_tokens=False).ids``, little-endian unsigned 32-bit.

    The vocabulary drops white space, encodes each run of letters apart and ends it with a token of its own kind. So ids of a text are
    the ids of its pieces between spaces, end to end, and the ids of many words are found by encoding them in one line and cutting it
    after the tokens that end a word. Each different piece is encoded once while it is remembered. A text that spells a
    special token is encoded whole, unless plain asks to read these as ordinary text. Whether a vocabulary is of this kind is found out once, on
    _PROBES; texts are encoded whole, one by one, with any other.
    """

    def __init__(self, path: str | None = None, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path or default_path())
        self._tokenizer.encode_special_tokens = plain
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(self._tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._special = [] if plain else [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[str, bytes] = {"": b""}
        whole = [array("I", self._tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in _PROBES]
        self.pieces = True
        self.pieces = bool(self._ends.any()) and [b"".join(self._block([x])) for x in _PROBES] == whole and b"".join(self._block([" ".join(_PROBES)])) == b"".join(whole)

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        held, size = [], 0
        for text in texts:
            if self.pieces and len(text) > 4 * AHEAD:  # a very long text goes in parts that end before a space
                yield from self._block(held)
                held, size = [], 0
                yield b"".join(self._block([part])[0] for part in _parts(text))
                continue
            held.append(text)
            size += len(text)
            if size >= AHEAD:
                yield from self._block(held)
                held, size = [], 0
        yield from self._block(held)

    def __call__(self, text: str) -> bytes:
        return self._block([text])[0]

    def _split(self, text: str) -> list[str] | None:
        if not self.pieces or any(s in text for s in self._special):
            return None
        try:
            text.encode("latin-1")
            text = text.lower()  # in these characters, lower case and normal form leave the ids as they are
        except UnicodeEncodeError:
            pass
        text = _MARKS.sub(r" \1", text)
        for space in "\n\t\r":
            if space in text:
                text = text.replace(space, " ")
        return text.split(" ")

    def _block(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        known = self._known
        if new := set().union(*(s for s in split if s)) - known.keys():
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                known[""] = b""
                new = set().union(*(s for s in split if s)) - {""}
            self._learn(new)
        found = known.__getitem__
        return [array("I", self._tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if s is None else b"".join(map(found, s)) for t, s in zip(texts, split, strict=True)]

    def _learn(self, new: set[str]) -> None:
        known = self._known
        words = [p for p in new if p.isalpha()]
        plain = [p for p in new if not p.isalpha()]
        if words:
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            stops = ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
            if len(stops) == len(words):
                data = ids.tobytes()
                known.update(zip(words, map(data.__getitem__, map(slice, [0, *stops], stops)), strict=True))
            else:  # a word that isn't one run for this vocabulary
                plain += words
        for piece, found in zip(plain, self._tokenizer.encode_batch_fast(plain, add_special_tokens=False), strict=True):
            known[piece] = array("I", found.ids).tobytes()


def _parts(text: str) -> Iterator[str]:
    begin = 0
    while begin < len(text):
        end = text.find(" ", begin + AHEAD)
        end = len(text) if end < 0 else end
        yield text[begin:end]
        begin = end


@cache
def encoder(path: str | None = None, plain: bool = False) -> Encoder:
    """The worker's encoder, kept from task to task with what it remembers."""
    return Encoder(path, plain)
