"""Texts as a reader sees them: disguises of letters and words undone, in tokens."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Container

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ue000\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_MARKUP = re.compile(r"<[^<>]{1,200}>|&[a-z]{2,8};|&#\d{1,6};", re.I)
#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans(
    {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t",
        "н": "h", "в": "b", "г": "r", "п": "n", "ո": "n", "ɡ": "g", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    }
)
#: Digits and signs written for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t", "€": "e", "8": "b", "9": "g"})
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ ._\-*·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_TOKEN = re.compile(r"[^\W_][^\s.,;:?()\[\]\"“”„«»/\\|<>{}=]*|[@$*#][^\s.,;:?()\[\]\"/\\|<>{}=]+")
_LETTER = re.compile(r"[^\W\d_]")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_COMPOUND = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]{2,})+")
_MASK = re.compile(r"[*#\-_~]{1,}")


def repaired(text: str) -> str:
    """Wrongly decoded UTF-8 put right, invisible and control characters and markup gone."""
    if "Ã" in text or "â€" in text or "Â" in text:
        try:
            text = re.sub(r"[ÂÃâ][\x80-\xff€-™ŒœŠšŽžŸƒˆ˜‚„†‡…‰‹›‘’“”•–—]{1,2}", lambda m: _redecoded(m[0]), text)
        except Exception:  # noqa: BLE001 - a text that can't be repaired stays as it is
            pass
    if not text.replace("\n", " ").isprintable():
        text = _INVISIBLE.sub("", text)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return text


def _redecoded(part: str) -> str:
    for encoding in ("cp1252", "latin-1"):
        try:
            return part.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
    return part


#: Put behind a word whose letters stood apart.
_JOINED = "\ue000"


def raw_tokens(text: str) -> list[str]:
    """The tokens of a repaired text as written; letters that stood apart are one token, marked as such."""
    text = repaired(text if text.isascii() else unicodedata.normalize("NFKC", text))
    return _TOKEN.findall(_SPACED.sub(lambda m: m[0].replace(m[1], "") + _JOINED, text))


def plain_words(raw: str, known: Container[str] = ()) -> tuple[list[str], int]:
    """(words, flags) of one raw token: lower case, disguises undone; flag bits 1 capitals, 2 disguised, 4 exclamation after, 8 masked.

    A letter written three times or more stands for one, or for two where that is a ``known`` word.
    """
    apart = raw.endswith(_JOINED)
    raw = raw.replace(_JOINED, "")
    shouted = raw.endswith("!")
    word = raw.rstrip("!'’-_~*#$@+" if raw[-1:] in "!'’-_~" else "!'’")
    if not word:
        return [], 0
    flag = 4 * shouted + (len(word) > 2 and word.isupper()) + 2 * apart
    low = word.lower() if word.isascii() else word.translate(_LOOKALIKES).lower().translate(_LOOKALIKES)
    if low != word.lower():
        flag |= 2
    if low[0].isdigit() and not _LETTER.search(low):
        return ["0"], flag & 4
    if not low.isalpha():
        if _LETTER.search(low) and any(c in "0134578@$!+€9" for c in low) and not re.fullmatch(r"\d+(?:st|nd|rd|th|mm|px|kn|s|h|%)?", low):
            solved = low.translate(_LEET)
            if solved.isalpha():
                low, flag = solved, flag | 2
        if _MASK.search(low) and _LETTER.search(low) and not any(c.isdigit() for c in low):
            bare = _MASK.sub("", low)
            if len(bare) <= len(low) - 1 and not _COMPOUND.fullmatch(low):
                flag |= 8
    if _REPEAT.search(low):
        twice = _REPEAT.sub(r"\1\1", low)
        low, flag = twice if twice in known else _REPEAT.sub(r"\1", low), flag | 2
    return low.split("-") if _COMPOUND.fullmatch(low) else [low.strip("'’")], flag


def tokens_of(text: str) -> tuple[list[str], list[int]]:
    """(words, flags) of a text, each word with the flags of its token."""
    words, flags = [], []
    for raw in raw_tokens(text):
        w, f = plain_words(raw)
        words += w
        flags += [f] * len(w)
    return words, flags
