"""Column builders for the text rules.

All of them stay inside the JVM.  The rules were defined on Unicode strings, so
character classes are spelled out instead of relying on Java's ASCII defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points a Unicode-aware strip removes, and the same set as a
# regular-expression class.
BLANKS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
BLANK_CLASS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"
UPPER = r"\p{IsUppercase}"
LOWER = r"\p{IsLowercase}"
ALNUM = r"\p{L}\p{N}"
WORD = r"\p{L}\p{N}_"


def lit(value) -> Column:
    return F.lit(value)


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(c, F.lit(BLANKS))


def rstrip_chars(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def replace_all(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def words(c: Column) -> Column:
    """Split on runs of white space, no empty items."""
    return F.filter(F.split(c, f"[{BLANK_CLASS}]+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def count_class(c: Column, char_class: str) -> Column:
    """How many characters of ``c`` fall into ``char_class``."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{char_class}]+", ""))


def first_char(c: Column) -> Column:
    return F.substring(c, 1, 1)


def last_char(c: Column) -> Column:
    return F.right(c, F.lit(1))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def is_upper(c: Column) -> Column:
    return matches(c, f"[{UPPER}]") & ~matches(c, rf"[{LOWER}\p{{Lt}}]")


def is_lower(c: Column) -> Column:
    return matches(c, f"[{LOWER}]") & ~matches(c, rf"[{UPPER}\p{{Lt}}]")


def is_title(c: Column) -> Column:
    """Every capital starts a letter run and every small letter continues one."""
    broken = rf"[{CASED}][{UPPER}\p{{Lt}}]|(?:^|[^{CASED}])[{LOWER}]"
    return matches(c, rf"[{UPPER}\p{{Lt}}]") & ~matches(c, broken)


def starts_continuation(c: Column) -> Column:
    """First character is a small letter or one of , ; : - ."""
    return matches(first_char(c), f"[{LOWER},;:\\-]")


def unfinished(c: Column) -> Column:
    """No sentence end once closing quotes and brackets are removed."""
    return ~last_char(rstrip_chars(c, "\"')")).isin(".", "!", "?")


def both(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))


# The same rules as SQL text, for operators written with selectExpr.


def sql_strip(c: str) -> str:
    return f"btrim({c}, '{BLANKS}')"


def sql_words(c: str) -> str:
    return f"filter(split({c}, r'[{BLANK_CLASS}]+'), w -> w != '')"


def sql_count(c: str, char_class: str) -> str:
    return f"(length({c}) - length(regexp_replace({c}, r'[{char_class}]+', '')))"


def sql_rlike(c: str, pattern: str) -> str:
    """``pattern`` may hold both quote signs; they are passed as code points."""
    safe = pattern.replace("'", r"\x27").replace('"', r"\x22")
    return f"rlike({c}, r'{safe}')"


def portable(pattern: str) -> str:
    r"""Make \s and \d cover Unicode, as the rules were defined."""
    return pattern.replace(r"\s", f"[{BLANK_CLASS}]").replace(r"\d", r"\p{Nd}")
