"""Letters of texts as code points, for language ID, and as small classes with trigrams as integers, for toxicity."""

from __future__ import annotations

import numpy as np

#: Class 0 is anything but a letter; 1 to 26 are a to z; other letters share the rest by code point.
OTHERS = 22
CLASSES = 27 + OTHERS
TOP = 0x20000
GRAMS = CLASSES**3

_TABLE: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Class of each code point below ``TOP``; the last entry stands for all above."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(TOP + 1, np.uint8)
        letters = np.fromiter((chr(i).isalpha() for i in range(TOP)), bool, TOP)
        t[:TOP][letters] = 27 + np.flatnonzero(letters) % OTHERS
        t[ord("a") : ord("z") + 1] = np.arange(1, 27)
        t[TOP] = 27
        _TABLE = t
    return _TABLE


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text's letters, runs of anything else as one 0, with a 0 at both ends; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    c = np.where(class_table()[np.minimum(points, TOP)] != 0, points, 0)
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    return c if len(c) > 1 else c[:0]


def classes(text: str) -> np.ndarray:
    """Classes of the lower-cased text, runs of non-letters as one 0, with a 0 at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = class_table()[np.minimum(points, TOP)]
    c = np.concatenate([[0], c, [0]]).astype(np.int64)
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def trigrams(text: str) -> np.ndarray:
    """Numbers of the letter trigrams of a text, word ends included."""
    c = classes(text)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
