"""Pre-tokens of byte-level BPE: the public pattern, with a faster form for Latin text."""

from __future__ import annotations

import re
from functools import cache

import regex

#: Unicode White_Space, which ``\s`` means to the tokenizer libraries.
SPACE = r"\t-\r \x85\xa0  -     　"
# The letters, numbers and spaces up to U+024F, so that the built-in engine can be used there.
_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_latin = re.compile(f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_beyond = re.compile("[^\x00-ɏ]")


@cache
def _general():
    import public_tokenizers

    inside = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]")
    return regex.compile(inside)


def pretokens(text: str) -> list[str]:
    """The pattern's matches, which together are the whole text."""
    return (_general() if _beyond.search(text) else _latin).findall(text)
