"""Exact ids and counts by the tokenizers library, with each distinct chunk encoded once a worker.

A text is cut only where the file's pre-tokenizer cuts it too, so the ids of the chunks in a row
are those of the text. Chunks of letters and closing punctuation go to the model at once; all
others go through the library's whole chain.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

#: Chunks that a worker remembers at most.
REMEMBERED = 500_000
#: Longer texts are cut at safe places before they are split into chunks.
PART_CHARS = 1_000_000

#: Letters of Latin-1 that no normalizer changes but for case, and ASCII punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(keep))
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _stand_in(text: str) -> str:
    return text if text.isascii() and " " not in text and "\n" not in text else "".join(_LETTERS[b] for b in text.encode())


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds(dict):
    """Ids (4 bytes each, little-endian) of chunks between white space, for a file that drops white space and lower-cases."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if m := _PLAIN.fullmatch(text):
            ids = [t.id for part in m.groups() if part for t in self.model.tokenize(_stand_in(part.lower()))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        out = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(self) < REMEMBERED and len(chunk) < 200:
            self[chunk] = out
        return out

    def ids(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if text else b""


#: White space, or what some version of Unicode takes for it, before a space or line feed; and the mark used below.
_UNSAFE = re.compile(r"[\s\u180e\u200b\ufeff][ \n]|\x00")
_CUT = re.compile(r"(?<![\s\u180e\u200b\ufeff])(?=[ \n])")


class SpacedCounts(dict):
    """Number of ids of chunks, for a byte-level file whose pre-tokenizer puts a space before a word with it.

    Keys: a chunk without the space it begins with, or NUL and what follows a line feed.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, key: str) -> int:
        lead, rest = ("\n", key[1:]) if key[:1] == "\x00" else (" ", key)
        if m := _PLAIN.fullmatch(rest):
            first, then = m.groups()
            n = len(self.model.tokenize(_stand_in(first if lead == "\n" else " " + first)))
            n += len(self.model.tokenize(_stand_in(then))) if then else 0
            n += len(self.model.tokenize(_LETTERS[10])) if lead == "\n" else 0
        else:
            n = self.whole(lead + rest)
        if len(self) < REMEMBERED and len(key) < 200:
            self[key] = n
        return n

    def parts(self, text: str, limit: int = PART_CHARS) -> Iterator[str]:
        """The text in parts of about ``limit`` characters, cut where a token must end."""
        start = 0
        while len(text) - start > limit:
            m = _CUT.search(text, start + limit)
            if not m:
                break
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text

    def count(self, text: str) -> int:
        n = 0
        for k, part in enumerate(self.parts(text)):
            if k == 0:  # what comes before the first safe place has no white space before it
                m = _CUT.search(part, 1)
                head = m.start() if m else len(part)
                n += self.whole(part[:head]) if head else 0
                part = part[head:]
            if not part:
                continue
            if "\x00" in part:
                n += sum(self.whole(x) for x in _CUT.split(part) if x)
            elif _UNSAFE.search(part):
                n += sum(self[x[1:] if x[0] == " " else "\x00" + x[1:]] for x in _CUT.split(part) if x)
            else:
                n += sum(map(self.__getitem__, part.replace("\n", " \x00").split(" ")[1:]))
        return n


@lru_cache(4)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path)


@lru_cache(4)
def spaced_counts(path: str) -> SpacedCounts:
    return SpacedCounts(path)
