"""Token ids by the tokenizers library, with the ids of words that were seen before.

A text is cut into units that the tokenizer treats apart: at blanks and line
breaks between other characters.  Units not seen before go through the library
in one call, with a control character between them where white space has no ids;
the ids of a text are the joined ids of its units.  Texts with other white space,
and units with a special token or that character, go through the library alone.
"""

from __future__ import annotations

import os
import re
from pathlib import Path

import numpy as np

# Units kept by a Python worker; beyond that it starts anew.
KEPT = 1_000_000
# Longer units are encoded without being kept.
LONGEST = 64

# White space other than blanks and line breaks.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
MARK = "\x02"


def odd_space(text: str) -> bool:
    """Whether some white space is not one blank or line break between two other characters."""
    return (
        text[0] in " \n"
        or text[-1] in " \n"
        or "  " in text
        or "\n\n" in text
        or " \n" in text
        or "\n " in text
        or OTHER_SPACE.search(text) is not None
    )


_READY: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of a tokenizer file in this process."""
    if path not in _READY:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _READY[path] = Encoder(path)
    return _READY[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = self.tokenizer.get_added_tokens_decoder()
        self.alone = [t.content for t in special.values()]
        # without a normaliser white space has ids of its own
        self.spaced = self.tokenizer.normalizer is None
        if self.spaced:
            # one character of a byte-level token stands for one byte
            vocab = self.tokenizer.get_vocab()
            self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self.sizes[i] = len(token)
        else:
            self.alone.append(MARK)
            self.mark = self._raw(MARK)
        self.kept: dict[str, bytes] = {}

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _spelled(self, unit: str) -> str:
        """A unit with the blank before it, where blanks belong to ids."""
        return unit if not self.spaced or unit[:1] == "\n" else f" {unit}"

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of new units, as bytes."""
        found = {}
        # one search in all of them first: special tokens are rare
        together = "\x00".join(units)
        if any(s.strip(" ") in together for s in self.alone):
            odd = {u for u in units if any(s in self._spelled(u) for s in self.alone)}
            found = {u: self._raw(self._spelled(u)).tobytes() for u in odd}
            units = units - odd
        plain = list(units)
        for at in range(0, len(plain), 50_000):
            part = plain[at : at + 50_000]
            if self.spaced:
                texts = list(map(self._spelled, part))
                ids = self._raw("".join(texts))
                upto = np.cumsum(self.sizes[ids])
                bounds = np.cumsum([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts])
                ends = np.searchsorted(upto, bounds) + 1
                starts = np.append(0, ends[:-1])
                whole = np.array_equal(upto[ends - 1], bounds)
            else:
                ids = self._raw(f" {MARK} ".join(part) + f" {MARK}")
                ends = np.flatnonzero(ids == self.mark[0])
                starts = np.append(0, ends[:-1] + 1)
                whole = len(self.mark) == 1 and len(ends) == len(part)
            if not whole:
                raise ValueError("the ids do not fall apart into those of the units")
            data = ids.tobytes()
            found.update(zip(part, [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]))
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without added special tokens."""
        cut: list[list[str] | None] = []
        for text in texts:
            if text is None or text == "":
                cut.append([])
            elif self.spaced:
                # a line break stays with the unit behind it; the first unit gets one that is dropped again
                cut.append(None if odd_space(text) else f"\n{text}".replace("\n", " \n")[1:].split(" "))
            else:
                if text.isascii():
                    text = text.lower()
                cut.append(text.replace("\n", " ").split(" "))
        if len(self.kept) > KEPT:
            self.kept = {}
        new = {u for units in cut if units for u in units}.difference(self.kept)
        extra = {}
        if new:
            learned = self._learn(new)
            long = [u for u in learned if len(u) > LONGEST]
            extra = {u: learned.pop(u) for u in long}
            self.kept.update(learned)
        kept = self.kept
        if extra:
            kept = {**{u: kept[u] for units in cut if units for u in units if u not in extra}, **extra}
        out = []
        for text, units in zip(texts, cut):
            if units is None:
                out.append(self._raw(text))
            else:
                ids = np.frombuffer(b"".join(map(kept.__getitem__, units)), np.uint32)
                out.append(ids[1:] if self.spaced and len(ids) else ids)
        return out


def tokenizer_path(name: str) -> str:
    """Where a tokenizer file lies; the folder can be set by the caller's own path instead."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))
