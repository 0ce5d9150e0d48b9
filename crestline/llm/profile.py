"""Counts of one whole text that the quality operators share."""

from __future__ import annotations

import unicodedata

import numpy as np

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Character classes, in the order of their numbers.
CLASSES = ("lower vowel", "lower consonant", "other lower", "upper", "digit", "space", "line end", "stop", "quote or bracket", "symbol", "other letter", "other")
_LIMIT = 0x3000


def _class_of(c: str) -> int:
    if c == "\n":
        return 6
    if c in SPACES or c.isspace():
        return 5
    if "a" <= c <= "z":
        return 0 if c in "aeiou" else 1
    if c.islower():
        return 2
    if c.isupper():
        return 3
    if c.isdigit():
        return 4
    if c in ".,;:?-":
        return 7
    if c in "\"'()[]":
        return 8
    if c.isalpha():
        return 10
    return 9 if unicodedata.category(c)[0] in "PS" else 11


TABLE = np.array([_class_of(chr(k)) for k in range(_LIMIT)] + [10], np.uint8)
#: Characters of a text that are classed at a time.
CHUNK = 1 << 20


def class_counts(text: str) -> np.ndarray:
    total = np.zeros(len(CLASSES), np.int64)
    for k in range(0, len(text), CHUNK):
        points = np.frombuffer(text[k : k + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        total += np.bincount(TABLE[np.minimum(points, _LIMIT)], minlength=len(CLASSES))
    return total


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur at least twice."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words))
    n = len(seen)
    pair = ids[:-1] * n + ids[1:]
    if n >= 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * n + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key), bool)
    twin = ranked[1:] == ranked[:-1]
    same[1:] |= twin
    same[:-1] |= twin
    inside = np.zeros(len(words), bool)
    hit = order[same]
    for k in range(3):
        inside[hit + k] = True
    return int(inside.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len({*lines}), repeated_words(words)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()
