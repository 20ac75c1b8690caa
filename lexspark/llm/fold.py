"""Texts as arrays of folded letters and digits, for comparing what is written and not how."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

SEP = 1  # between texts; no folded character has this code
_UNKNOWN, _LONG = 0xFFFFFFFF, 0xFFFFFFFE
_table: np.ndarray | None = None
_long: dict[int, str] = {}
_NUMBERED = re.compile(r"^[ \t　]*([(（\[【]?)(\d{1,4})([)）\]】.．、:：|]?)[ \t　]+(?=\S)", re.M)


def fold_char(ch: str) -> str:
    """Letters and digits of the character in one width and case; nothing for all others."""
    return "".join(c for c in unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", ch).casefold()) if c.isalnum())


def drop_line_numbers(text: str) -> str:
    """Without the numbers at line starts, where at least two lines one after the other are numbered in sequence and alike."""
    found = [(m, text.count("\n", 0, m.start())) for m in _NUMBERED.finditer(text)] if _NUMBERED.search(text) else []
    if len(found) < 2:
        return text
    gone = set()
    for (a, i), (b, j) in zip(found, found[1:]):
        if (a[1], a[3]) == (b[1], b[3]) and int(b[2]) - int(a[2]) == 1 and j - i <= 3:
            gone |= {a.span(), b.span()}
    out, at = [], 0
    for s, e in sorted(gone):
        out += [text[at:s]]
        at = e
    return "".join(out) + text[at:]


def fold_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, each text followed by SEP, and the positions of these separators."""
    global _table
    if _table is None:
        _table = np.full(0x110000, _UNKNOWN, np.uint32)
        _table[SEP] = SEP
        _table[0] = 0
    joined = "\x01".join(t.replace("\x01", "") for t in texts) + "\x01"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _table[raw]
    if (unknown := out == _UNKNOWN).any():
        for c in np.unique(raw[unknown]).tolist():
            f = fold_char(chr(c)) if not 0xD800 <= c < 0xE000 else ""
            _table[c] = ord(f) if len(f) == 1 else _LONG if f else 0
            if len(f) > 1:
                _long[c] = f
        out = _table[raw]
    if (more := out == _LONG).any():
        joined = joined.translate({c: _long[c] for c in np.unique(raw[more]).tolist()})
        out = _table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if (out >= _LONG).any():  # what an expansion holds may be new itself; it is folded already
            raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            for c in np.unique(raw[out >= _LONG]).tolist():
                _table[c] = c
            out = _table[raw]
    out = out[out != 0]
    return out, np.flatnonzero(out == SEP)
