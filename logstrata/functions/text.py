"""White-space handling that is linear in the length of the line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode calls white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The characters a regular expression's \s stands for in RE2.
REGEX_SPACE = "\t\n\x0c\r "


def trim_line(line: Column) -> Column:
    """Strip Unicode white space from both ends.

    A pattern for trailing blanks would retry at every inner run of them,
    which is quadratic on a hostile line. A trim with a character set is
    linear, but measures every character, so lines that need none skip it.
    """
    ends = F.concat(F.substring(line, 1, 1), F.substring(line, -1, 1))
    blank_end = F.rlike(ends, F.lit(f"[{WHITE_SPACE}]"))
    return F.when(blank_end, F.btrim(line, F.lit(WHITE_SPACE))).otherwise(line)


def dash_if_empty(value: Column) -> Column:
    """An absent or empty part is stored as a dash."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("-")).otherwise(value)
