"""Words of a text as a reader would take them: without case, punctuation, typography and markup."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

WORDS = re.compile(r"[^\W_]+")
#: Soft hyphen, zero-width characters and the byte order mark.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Letters that are written as a command.
LETTER_COMMANDS = {"ss": "ss", "ae": "ae", "AE": "ae", "oe": "oe", "OE": "oe", "aa": "a", "AA": "a", "o": "o", "O": "o", "l": "l", "L": "l", "i": "i", "j": "j"}

_FOREIGN = re.compile("[^\x00-\x7f]+")
_COMMENT = re.compile(r"(?m)^[ \t]*%+")
_JOINED = re.compile(r"(?<=\w)%\n[ \t]*")
_NO_GLYPH = re.compile(r"\\[-/]")
_ACCENT = re.compile(r"\\(?:['\"`^~=.]|[uvHcdbkrt](?![A-Za-z]))\s*\{?\\?([A-Za-z])(?![A-Za-z]*\{)\}?")
_LETTER = re.compile(r"\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])(?:\{\}|[ ])?")
_ARGUMENT = re.compile(r"\\(?:begin|end|cite[a-z]*|eqref|ref|pageref|autoref|label|index|vspace|hspace|includegraphics|input|include|textcolor|color|fontsize|href|url|footnotemark)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}")
_SPACE = re.compile(r"\\(?:[,;:!> \n]|\\)|~")
_COMMAND = re.compile(r"\\[A-Za-z@]+\*?")
_NOTE = re.compile(r"\s*\\(?:footnote|footnotetext|thanks|marginpar)(?:\[[^\]\n]*\])?\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}")
#: Tags that stand inside a word or a sentence; the others divide.
_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|sup|sub|small|tt|code|font|mark|abbr|wbr)(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))*\s*/?>", re.IGNORECASE)
_TAG = re.compile(r"</?(?:p|br|hr|div|li|ul|ol|dl|dt|dd|h[1-6]|table|thead|tbody|tr|td|th|pre|blockquote|img|html|head|body|title|section|article|figure|figcaption)(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))*\s*/?>|<!--.*?-->", re.IGNORECASE | re.DOTALL)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_LINK = re.compile(r"\]\((?:[a-z]+://|www\.|[/#])[^()\s]*\)")


@lru_cache(maxsize=100_000)
def _bare(run: str) -> str:
    """A run of other than ASCII characters in compatibility form, without accents and invisible characters."""
    return "".join(c for c in unicodedata.normalize("NFKD", run) if c not in INVISIBLE and not unicodedata.combining(c))


def plain(text: str) -> str:
    """The text without markup. Text in comments and unused definitions stays; names of
    environments, references and files go; notes stand after the text that they would interrupt; words
    that markup only divides are joined again, accents are dropped."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "<" in text and ">" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _LINK.sub("] ", text)
    if not text.isascii():
        text = _FOREIGN.sub(lambda m: _bare(m[0]), text)
    if "%" in text:
        if "%\n" in text:
            text = _JOINED.sub("", text)
        text = _COMMENT.sub(" ", text)
    if "\\" in text or "{" in text or "~" in text:
        text = _NO_GLYPH.sub("", text)
        if "\\footnote" in text or "\\thanks" in text or "\\marginpar" in text:
            notes: list[str] = []
            text = _NOTE.sub(lambda m: notes.append(m[1]) or " ", text)
            text = "\n\n".join([text, *notes])
        text = _ARGUMENT.sub(" ", text)
        text = _ACCENT.sub(r"\1", text)
        text = _LETTER.sub(lambda m: LETTER_COMMANDS[m[1]], text)
        text = _SPACE.sub(" ", text)
        text = _COMMAND.sub("", text)
        text = text.replace("{", "").replace("}", "")
    return text


def reader_words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits. Null gives none."""
    if not text:
        return []
    return WORDS.findall(plain(text).lower())
