"""Words of a text, alike however the text is dressed."""

from __future__ import annotations

import re
import unicodedata

#: Invisible characters outside category Cf (joiners, fillers, variation selectors).
INVISIBLE = "͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ"

_RUN = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(f"[{INVISIBLE}]")
_MAYBE_CF = re.compile("[­؀-؜۝܏࣢᠎​-‏‪-‮⁠-⁯﻿￹-￻\U00010000-\U0010ffff]")
_MOJIBAKE = re.compile("[ÂÃÅâ][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")


def plain(text: str) -> str:
    """Compatibility forms resolved, invisible characters out, letter case folded."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKC", text)
    t = _HIDDEN.sub("", t)
    if _MAYBE_CF.search(t):
        t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    return unicodedata.normalize("NFKC", t.casefold())


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in order; none for null, empty and wordless texts."""
    return _RUN.findall(plain(text)) if text else []


def mended(text: str) -> str:
    """UTF-8 that was read as cp1252 or Latin-1, read again; other texts unchanged."""
    if text.isascii() or not _MOJIBAKE.search(text):
        return text
    for wrong in ("cp1252", "latin-1"):
        try:
            return text.encode(wrong).decode("utf-8")
        except UnicodeError:
            continue
    return _MOJIBAKE.sub(lambda m: _again(m.group()), text)


def _again(pair: str) -> str:
    try:
        return pair.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return pair
