"""Texts as symbols for character models: letters in lower case, all else one blank."""

from __future__ import annotations

import functools

import numpy as np

#: The symbol of everything that is no letter; also stands before and behind each text.
BLANK = 0


@functools.cache
def _table() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, the lower-case letter's code
    below 2**16.  Letters beyond share symbols, 32 neighbours one, from 0xD800 on, where no
    letter stands, so that their scripts differ."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x34000):  # behind it there is no letter
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            code = ord(low if len(low) == 1 else ch)
            out[c] = code if code < 0x10000 else 0xD800 + (code - 0x10000 >> 5)
    return out


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes as code points, and each text's offsets among them."""
    raw = data.tobytes()
    try:
        at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][off]
        return np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32), at
    except UnicodeError:
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
        return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def symbols(data: np.ndarray, off: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each led by ``pad`` blanks and ended by one, runs of other
    blanks being one; and where each text's block starts (one more entry: the end)."""
    cp, off = code_points(data, off)
    s = _table()[cp]
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = s != BLANK
    inner = ~keep
    inner[1:] &= keep[:-1]  # the first blank behind a letter
    heads = off[:-1][np.diff(off) > 0]
    inner[heads] = False
    tails = off[1:][np.diff(off) > 0] - 1
    inner[tails] = False
    keep |= inner
    s, owner = s[keep], owner[keep]
    n = np.bincount(owner, minlength=len(off) - 1)
    start = np.r_[0, np.cumsum(n + pad + 1)]
    out = np.zeros(start[-1], np.uint16)
    out[np.arange(len(s)) + owner * (pad + 1) + pad] = s
    return out, start
