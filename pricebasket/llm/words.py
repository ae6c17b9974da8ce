"""Words of whole texts for operators that count or match them: runs of ASCII letters, digits and all that isn't ASCII."""

from __future__ import annotations

import re

# Fixed value: what a word is, in a text in which A-Z are lower-case; as bytes of UTF-8, and the same in SQL.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, each as bytes; only A-Z are lower-cased."""
    return WORD.findall(text.encode().lower()) if text else []


def words_sql(column: str) -> str:
    """The list of a text's words, in SQL."""
    return f"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_SQL}')"
