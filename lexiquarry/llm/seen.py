"""Text "as seen": the one form under which texts that look the same are equal.

White space of any kind becomes one space and none at the ends, characters without a
glyph vanish, full-width characters become the normal ones, and letters of other
scripts that are shaped like a Latin letter become that letter. Separate accents are
left to the caller: the SQL form relies on collation, the Python form composes them.
Case, accents, raised digits and marks stay as they are.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts drawn like a Latin letter in usual typefaces.
LOOK_ALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ρ": "p", "Ϲ": "C", "ϲ": "c", "Ϳ": "J", "ϳ": "j",
    # Coptic
    "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X", "ⲭ": "x",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ѵ": "V", "Ү": "Y", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѡ": "w", "ѵ": "v", "ү": "y",
    "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Armenian
    "Լ": "L", "Տ": "S", "Օ": "O", "Ս": "U", "զ": "q", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "ց": "g", "օ": "o",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S",
    "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓒ": "d", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}

#: Full-width forms U+FF01..U+FF5E lie at a fixed distance from ASCII; the signs after them don't.
FULL_WIDTH = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict(zip("￠￡￢￣￤￥￦", "¢£¬¯¦¥₩"))

#: White space: the Unicode property plus the separators that some regex dialects leave out.
SPACE_CLASS = "\\t\\n\\u000b\\f\\r \\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Characters without a glyph: controls and the default-ignorable code points.
BLANK_CLASS = (
    "\\u0000-\\u0008\\u000e-\\u001b\\u007f-\\u0084\\u0086-\\u009f\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f"
    "\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0\\ufff0-\\ufff8"
)
#: The same beyond the 16-bit plane: beams, tags and variation selectors.
BLANK_HIGH = ((0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))

_FROM, _TO = (("".join(x)) for x in zip(*(LOOK_ALIKES | FULL_WIDTH).items()))
_JAVA_BLANK = f"[{BLANK_CLASS}{''.join(f'\\x{{{a:X}}}-\\x{{{b:X}}}' for a, b in BLANK_HIGH)}]+"
_PY_BLANK = re.compile(f"[{BLANK_CLASS}{''.join(f'\\U{a:08x}-\\U{b:08x}' for a, b in BLANK_HIGH)}]+")
_PY_SPACE = re.compile(f"[{SPACE_CLASS}]+")
_MAP = str.maketrans(_FROM, _TO)
_WORD = re.compile(r"[^\W_]+")


def is_blank(character: str) -> bool:
    return _PY_BLANK.fullmatch(character) is not None


def is_space(character: str) -> bool:
    return _PY_SPACE.fullmatch(character) is not None


def letter_seen(character: str) -> str:
    """The character that a single one is taken for."""
    return unicodedata.normalize("NFC", character.translate(_MAP)).translate(_MAP)


#: Texts of these characters alone only need their white space looked at.
_NOT_PLAIN = "[^\\t\\n\\r -~]"
#: White space that isn't a single space already.
_ODD_SPACE = f"[{SPACE_CLASS}]{{2,}}|[{SPACE_CLASS}&&[^ ]]"


def folded(text: Column) -> Column:
    """``text`` as seen, but for separate accents, as a built-in expression. Null stays null."""
    shown = F.when(text.rlike(_NOT_PLAIN), F.regexp_replace(F.translate(text, _FROM, _TO), _JAVA_BLANK, "")).otherwise(text)
    return F.trim(F.regexp_replace(shown, _ODD_SPACE, " "))


def visible(text: Column) -> Column:
    """Whether a text has anything to see, told by its first visible character; false for null."""
    return F.coalesce(text.rlike(f"[^{SPACE_CLASS}{_JAVA_BLANK[1:-2]}]"), F.lit(False))


#: Only a text with such a character can hold marks in an unsettled order.
MARKS = "\\p{M}"
#: Marks in a row, or a mark behind a letter that may hold one: only there is the order unsettled.
UNSETTLED = "\\p{M}{2}|[\\x{C0}-\\x{10FFFF}&&\\p{L}]\\p{M}"


@F.pandas_udf(StringType())
def settled(texts: pd.Series) -> pd.Series:
    """Texts with their marks in canonical order, as collation needs it. Null stays null."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def as_seen(text: str) -> str:
    """``text`` as seen, accents composed."""
    if text.isascii():
        text = _PY_BLANK.sub("", text)
    else:
        # A full-width or look-alike letter can carry an accent, so letters are mapped before and after composing.
        text = unicodedata.normalize("NFC", _PY_BLANK.sub("", text).translate(_MAP)).translate(_MAP)
    return _PY_SPACE.sub(" ", text).strip(" ")


def words_seen(seen: str) -> list[str]:
    """The words of a text that is already as seen."""
    return _WORD.findall(seen.lower())


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters or digits as seen, in lower case. Null and blank texts have none."""
    return words_seen(as_seen(text)) if text else []
