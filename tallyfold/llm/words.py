"""Words of a text as they are compared across copies: no case, punctuation, markup, invisible characters or layout."""

from __future__ import annotations

import re
import unicodedata

#: Tags that stand inside a line of text, entities that are spaces, entities that are not seen.
INLINE_TAGS = "a|abbr|b|big|code|del|em|font|i|ins|mark|s|small|span|strong|sub|sup|tt|u"
SPACE_ENTITIES = "nbsp|ensp|emsp|thinsp|#160|#xa0"
UNSEEN_ENTITIES = "shy|zwnj|zwj|#173"
#: Marks that part words where they stand between them.
PARTING = "—―/|"

_INLINE = re.compile(rf"</?(?:{INLINE_TAGS})(?:\s[^<>]*)?>")
_TAG = re.compile(r"<[^<>]*>")
_SPACE = re.compile(rf"&(?:{SPACE_ENTITIES});")
_UNSEEN = re.compile(rf"&(?:{UNSEEN_ENTITIES});")
_AND = re.compile(r"&(?:amp|#38);")
_ENTITY = re.compile(r"&(?:[a-z][a-z0-9]{1,30}|#[0-9]{1,7}|#x[0-9a-f]{1,6});")
_ESCAPE = re.compile(r"\\[nrt]")


class _Kept(dict):
    """For ``str.translate``: letters and digits stay, white space and parting marks become a space, the rest goes."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kept = c if c.isalnum() else " " if c.isspace() or c in PARTING else None
        self[code] = kept
        return kept


_KEPT = _Kept()


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for NULL.

    Lower case, compatibility forms of characters unified; tags, entities and escaped line breaks are resolved, ``&``
    reads ``and``, punctuation is taken out of words (``63.1`` and ``631`` are equal), and dashes between words, slashes
    and bars part them.
    """
    if not text:
        return []
    t = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    if "<" in t:
        t = _TAG.sub(" ", _INLINE.sub("", t))
    if "&" in t:
        t = _ENTITY.sub("", _AND.sub("&", _UNSEEN.sub("", _SPACE.sub(" ", t)))).replace("&", " and ")
    if "\\" in t:
        t = _ESCAPE.sub(" ", t)
    return t.translate(_KEPT).split()
