"""Texts as streams of letter codes: what is left when case, accents, punctuation, blanks and hyphens are gone."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Letters a to z are 0 to 25, digits 26 to 35; letters of other scripts share the codes 36 to 63; the rest is dropped.
DROP, FIRST_OTHER, OTHERS = 255, 36, 28
_TABLE: np.ndarray | None = None
#: Letters that stand for two.
_TWO = {"ß": "ss", "ẞ": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe"}


def letter_code(char: str) -> int:
    """The code of a character, ``DROP`` for what is no letter or digit.

    Compatibility forms, case and accents are folded first. A letter outside a to z
    and 0 to 9 takes one of ``OTHERS`` codes by its code point, so one misread letter
    in that many goes unseen; vowel signs that take a place of their own count as
    letters, marks above or below do not.
    """
    folded = "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", char).casefold()) if unicodedata.category(c) != "Mn")
    for c in folded:
        if c.isascii() and c.isalnum():
            return ord(c) - 97 if c.isalpha() else ord(c) - 22
    kept = [c for c in folded if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Mc"]
    if not kept:
        return DROP
    mixed = 0
    for c in kept:
        mixed = (mixed * 31 + ord(c)) & 0xFFFFFFFF
    return FIRST_OTHER + ((mixed * 2654435761) & 0xFFFFFFFF) * OTHERS // (1 << 32)


def _table() -> np.ndarray:
    """Codes of the basic plane; what lies above it is looked up as it occurs."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([DROP if 0xD800 <= cp < 0xE000 else letter_code(chr(cp)) for cp in range(0x10000)], np.uint8)
    return _TABLE


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text, line) of all letters of the texts, in order; lines count through all texts."""
    joined = "\n".join(texts)
    for one, two in _TWO.items():
        if one in joined:
            texts = [t.replace(one, two) for t in texts]
            joined = "\n".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(cp)]
    line = np.cumsum(cp == 10)
    code = _table()[np.minimum(cp, 0xFFFF)]
    above = np.flatnonzero(cp >= 0x10000)
    if len(above):
        rare, which = np.unique(cp[above], return_inverse=True)
        code[above] = np.array([letter_code(chr(c)) for c in rare], np.uint8)[which]
    keep = np.flatnonzero(code != DROP)
    return code[keep], owner[keep], line[keep]


#: Scripts written without blanks: letters that count as a word together.
_HAN_KANA = "\u2e80-\u2fdf\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_SOUTH_EAST = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff"
_RUNS = re.compile(f"[{_HAN_KANA}]{{1,2}}|[{_SOUTH_EAST}]{{1,5}}|[^{_HAN_KANA}{_SOUTH_EAST}]+")


def words_of(text: str) -> list[str]:
    """The words of a text: between blanks, and in scripts without blanks two (Han, kana) or five (Thai, Lao, Burmese, Khmer) letters each."""
    return [w for token in text.split() for w in _RUNS.findall(token) if any(letter_code(c) != DROP for c in w)]


def grams(code: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """The k letters from each place as one number (k up to 10); -1 where they leave their text."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    g = np.zeros(n, np.int64)
    for i in range(k):
        g <<= 6
        g |= code[i : i + n]
    g[owner[:n] != owner[k - 1 :]] = -1
    return g


def slot(g: np.ndarray, bits: int = 22) -> np.ndarray:
    """A place in a table of 2**bits flags."""
    return (g * np.int64(-7046029254386353131)) >> np.int64(64 - bits) & np.int64((1 << bits) - 1)


class GramSet:
    """Membership of numbers in a sorted set, with flags that settle most questions first."""

    def __init__(self, values: np.ndarray, bits: int = 22):
        self.values = np.unique(values[values >= 0])
        self.bits = bits
        self.flags = np.zeros(1 << bits, bool)
        self.flags[slot(self.values, bits)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``g``, places in the set) of the numbers that are in the set."""
        if not len(self.values) or not len(g):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.flags[slot(g, self.bits)] & (g >= 0))
        j = np.minimum(np.searchsorted(self.values, g[at]), len(self.values) - 1)
        good = self.values[j] == g[at]
        return at[good], j[good]


#: Bytes of text that are turned into arrays at a time (about 60 bytes of memory a letter).
SLICE_BYTES = 2_000_000


def slices(batch, column: int, limit: int = SLICE_BYTES):
    """A record batch in runs of rows with about ``limit`` bytes of text each; a longer text is a run of its own."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        base = int(size[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end
