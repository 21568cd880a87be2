"""Repair of damaged text: UTF-8 that was read byte for byte, and characters that stand for plain ones.

A run of characters that bytes of a one-byte code page may have become is read as bytes again, and
each byte sequence that UTF-8 allows becomes its character where that looks better: the cost of what
stands there (symbols and control characters in a row) must be over the cost of what would (letters
of common scripts cost nothing, rare marks much; one ideograph alone may as well be a letter and its quotes). So ``cafÃ©`` changes and ``CAFÉ»`` does not. Text that was
damaged several times is repaired as often. Texts without such characters are left as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

#: Characters after which a text is cut at the next line feed.
CUT = 1 << 20
_PASSES = 4


def _read_back() -> dict[str, int]:
    """The byte from 0x80 on that each character of Windows-1252 (or the control character of its number) was."""
    out = {chr(b): b for b in range(0x80, 0x100)}
    for b in range(0x80, 0xA0):
        try:
            out[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return out


_BYTE = _read_back()
_RUN = re.compile(f"[{re.escape(''.join(_BYTE))}]{{2,}}")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: What a character costs as the outcome, by the first code point after its range: scripts with many texts little.
_COSTS = ((0x180, 0.5), (0x370, 2.0), (0x530, 0.5), (0x590, 2.0), (0x5D0, 2.0), (0x700, 0.5), (0x900, 2.0))
_QUOTES = str.maketrans({"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"'})
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def outcome_cost(c: str) -> float:
    """How odd a character is that a repair would make."""
    if unicodedata.category(c) in ("Cn", "Co", "Cs", "Cc"):
        return 3.0
    if c in _BYTE:
        return 0.0
    return next((cost for top, cost in _COSTS if ord(c) < top), 0.0)


def damage_cost(s: str) -> float:
    """How odd it is that these characters stand in a row: each but letters counts, control characters thrice."""
    cost = 0.5 if s[0] in "ÂÃâÄÅÎÏÐÑØÙðï" else 0.0
    for c in s[1:]:
        kind = unicodedata.category(c)
        cost += 3.0 if kind == "Cc" else 0.75 if kind.startswith("L") else 1.0
    return cost


def _reread(m: re.Match) -> str:
    run = m[0]
    data = bytes(_BYTE[c] for c in run)
    out, at = [], 0
    found = list(_SEQUENCE.finditer(data))
    for s in found:
        try:
            c = s[0].decode()
        except UnicodeDecodeError:
            continue
        alone = len(found) == 1 and unicodedata.category(c) == "Lo"
        if max(outcome_cost(c), 2.0 * alone) < damage_cost(run[s.start() : s.end()]):
            out += [run[at : s.start()], c]
            at = s.end()
    return "".join([*out, run[at:]]) if at else run


def reread(text: str) -> str:
    """``text`` with what was read byte for byte read as UTF-8, as often as that changes it."""
    for _ in range(_PASSES):
        again = _RUN.sub(_reread, text)
        if again == text:
            break
        text = again
    return text


def repair(text: str) -> str:
    """Read again; plain quotes and ligatures; line feeds only; no control characters; composed."""
    text = reread(text).translate(_QUOTES)
    for a, b in _LIGATURES.items():
        text = text.replace(a, b)
    text = re.sub("[\x00-\x08\x0b\x0e-\x1f\x7f﻿]", "", text.replace("\r\n", "\n").replace("\r", "\n"))
    return unicodedata.normalize("NFC", text)


def cut_and_repair(text: str, most: int = CUT, fix: Callable[[str], str] = repair) -> str:
    """``text``, cut at the first line feed from place ``most`` on (there, if none follows), and repaired.

    Where the repair fails, half as much is tried, down to nothing: then the cut text is as it was.
    """
    if len(text) > most:
        end = text.find("\n", most)
        text = text[: most if end < 0 else end]
    while True:
        try:
            return fix(text)
        except Exception:
            most //= 2
            if most == 0:
                return text
            if len(text) > most:
                end = text.find("\n", most)
                text = text[: most if end < 0 else end]


def segments(text: str, squeeze: bool) -> tuple[list[str], list[str]]:
    """The stretches between runs of tabs and line ends (white space squeezed, if asked), and the run after each."""
    parts = re.split(r"([\t\r\n]+)", text)
    inner, after = parts[::2], [*parts[1::2], ""]
    return [re.sub(r"\s+", " ", s).strip() for s in inner] if squeeze else inner, after


def spelled(run: str) -> str:
    """A run of separators as escapes, a space between characters: a line feed is a backslash, a space and an n."""
    return " ".join(run.encode("unicode_escape").decode("ascii"))


def joined(tokens: list[list[str]], after: list[str]) -> str:
    """Each segment's tokens and the run after it, spaces between."""
    return " ".join(" ".join(t) + " " + spelled(run) for t, run in zip(tokens, after)).strip()
