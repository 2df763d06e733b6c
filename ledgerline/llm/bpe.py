"""Whole-text BPE encoding with the tokenizers library and a bounded memo of words.

Neither public vocabulary merges across the last blank of a run: one drops white
space, the other makes a space the start of the next word and any other blank a
unit.  So a text is the concatenation of its words, and a word that was seen
before need not be encoded again.  A word of letters with marks after it is two
units for both; its letters go straight to the library's BPE model.  Probes at the
start compare both assumptions with whole calls: a vocabulary whose merges cross a
blank is encoded by whole texts, one whose words of letters differ by the library.
``tests/llm`` compare whole texts.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterator
from itertools import chain

from . import memory

MEMO_WORDS = 1_000_000
MEMO_CHARS = 48

#: A blank that is not the last of its run, or ends the text.
_RUN = re.compile(r"[ \n](?:\s|\Z)")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_PROBE = ["stream", "Wörter", "État", "naïve", "ALL", "Straße", "ñandú", "x", "antidisestablishment"]
#: Texts with blanks and line breaks between letters, digits and marks, which may be cut there.
_SPACED = [a + gap + b for gap in (" ", "\n", " \n", "\n\n", "  ", "\t ", "\r\n") for a in ("the", "x.", "7", "É") for b in ("of the", "\"in", "42", "ñ a", "'s")]
_OPEN: dict[str, "WordEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTES = _byte_letters()
memory.register("bpe", lambda: _OPEN.clear())


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._first: dict[str, bytes] = {}
        self._later: dict[str, bytes] = {}
        self._lowers = self._tokenizer.normalizer is not None
        self._newline = self._library(["\n"])[0]
        self._apart = True
        self._fast = False
        self._apart = self.encode_many(_SPACED) == self._library(_SPACED)
        self._first.clear()
        self._later.clear()
        self._fast = self._apart and all([self._library([s + w for w in _PROBE]) == [self._letters(s, w) for w in _PROBE] for s in ("", " ")])

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [array("I", e.ids).tobytes() for e in found]

    def _letters(self, before: str, word: str) -> bytes:
        """Ids of a word of letters by the BPE model alone."""
        if self._lowers:
            word = word.lower()
        elif before:
            word = before + word
        mapped = word if word.isascii() and not before else word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Put words into the memo: those that follow a space, and with it those that follow a line break."""
        memo, first, slow = self._later, self._first, []
        for w in words:
            line = w[:1] == "\n"
            body = w[1:] if line else w
            letters = body.rstrip(string.punctuation)
            # Above U+00FF normalization may change a letter, which is left to the library.
            if not (self._fast and letters.isalpha() and (not self._lowers or max(letters) <= "\xff")):
                slow.append(w)
                continue
            known = first if line else memo
            if (ids := known.get(letters)) is None:
                ids = known[letters] = self._letters("" if line else " ", letters)
            if letters != body:
                tail = body[len(letters) :]
                if tail not in first:
                    first[tail] = self._library([tail])[0]
                ids += first[tail]
            memo[w] = self._newline + ids if line else ids
        memo.update(zip(slow, self._library([w if w[:1] == "\n" else " " + w for w in slow]), strict=True))

    def _words(self, text: str) -> list[str]:
        """The text cut at single spaces and before single line breaks; a run of blanks is never cut."""
        return _SAFE.split(text) if _RUN.search(text) else text.replace("\n", " \n").split(" ")

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers."""
        if not self._apart:
            return self._library(texts)
        split = [self._words(t) for t in texts]
        first, later = self._first, self._later
        if len(later) + len(first) > MEMO_WORDS:
            later.clear()
            first.clear()
        heads = {w[0] for w in split}.difference(first)
        rest = set(chain.from_iterable(w[1:] for w in split)).difference(later)
        first.update(zip(heads, self._library(list(heads)), strict=True))
        self._learn(rest)
        out = [first[w[0]] + b"".join(map(later.__getitem__, w[1:])) for w in split]
        for memo in (first, later):
            for w in [w for w in chain(heads, rest) if len(w) > MEMO_CHARS and w in memo]:
                del memo[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and vocabulary."""
    memory.claim("bpe")
    if path not in _OPEN:
        _OPEN[path] = WordEncoder(path)
    return _OPEN[path]


def in_chunks(texts: list, chars: int = 1 << 18) -> Iterator[list]:
    """Runs of texts with about ``chars`` characters each; a longer text is a run of its own."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= chars:
            yield run
            run, held = [], 0
    if run:
        yield run
