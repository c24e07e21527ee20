"""Words of a text: maximal runs of letters and digits after invisible
characters are removed, in lower case."""

from __future__ import annotations

import itertools
import re
import unicodedata

import numpy as np
import xxhash

# fixed values: characters without a visible form besides those of category Cf
EXTRA_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180d\u180f\u3164\uffa0\ufe00-\ufe0f\U000e0100-\U000e01ef"



def _classed(wanted) -> str:
    """The characters for which wanted holds, as the inside of a pattern's class."""
    points = [o for o in itertools.chain(range(0x20000), range(0xE0000, 0xE0200)) if wanted(unicodedata.category(chr(o)))]
    runs = [list(g) for _, g in itertools.groupby(points, key=lambda o, n=itertools.count(): o - next(n))]
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


INVISIBLE = re.compile(f"[{_classed(lambda c: c == 'Cf')}{EXTRA_INVISIBLE}]+")
#: taken for letters or digits by the word pattern, yet neither
_OTHER = re.compile(f"[{_classed(lambda c: c in ('No', 'Nl'))}]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    if not text.isascii():
        text = INVISIBLE.sub("", text)
        text = _OTHER.sub(" ", text)
    return _WORD.findall(text.lower())


class WordHashes(dict):
    """64-bit hashes of words, kept for as long as they fit."""

    MOST = 2_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, some: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, some), np.uint64, len(some))
