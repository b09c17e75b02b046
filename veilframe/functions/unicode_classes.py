"""Regular-expression classes for pretokens, trimming and character counts.

Java and Python classes agree on assigned characters; a text with characters that the JVM's tables do not know is sent
through Python's ``regex`` instead (``needs_fallback``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and the ordered alternatives of the pretoken pattern.
SPACE = r"\t-\r\x{85}\p{Z}"
UPPER = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]"
LOWER = r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
SUFFIX = r"(?:'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD])?"
PRETOKEN = "|".join(
    [
        rf"[^\r\n\p{{L}}\p{{N}}]?{UPPER}*{LOWER}+{SUFFIX}",
        rf"[^\r\n\p{{L}}\p{{N}}]?{UPPER}+{LOWER}*{SUFFIX}",
        r"\p{N}{1,3}",
        rf" ?[^{SPACE}\p{{L}}\p{{N}}]+[\r\n/]*",
        rf"[{SPACE}]*[\r\n]+",
        rf"[{SPACE}]+(?![^{SPACE}])",
        rf"[{SPACE}]+",
    ]
)
#: White space that is trimmed off spans: White_Space and the separators U+001C to U+001F.
TRIM = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

CLASSES = {"letters": r"\p{L}", "numbers": r"\p{N}", "upper": UPPER, "lower": LOWER, "spaces": f"[{SPACE}]"}


def count_class(text: Column, cls: str) -> Column:
    """How many characters of ``text`` are in a class."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, cls, ""))


def python_pattern() -> str:
    """The pretoken pattern in the syntax of Python's ``regex`` module."""
    import re

    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", PRETOKEN)


def needs_fallback(text: Column) -> Column:
    """Texts with code points the JVM has no class for."""
    return text.rlike(r"[\p{Cn}&&[^\x{fdd0}-\x{fdef}]]")
