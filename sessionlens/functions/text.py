"""Text masking, session-key extraction and tokenising as built-in column expressions.

Every pattern runs in Java regex with ``(?U)`` (UNICODE_CHARACTER_CLASS) so that
``\\d``, ``\\w``, ``\\s`` and ``\\b`` carry their Unicode meaning, like Python 3 ``re``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the source system's patterns and replacement tokens) ----
IP_PATTERN = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
HEX_PATTERN = r"\b[0-9a-fA-F]{8,}\b"
NUM_PATTERN = r"\b\d+\b"
IP_TOKEN = "<ip>"
HEX_TOKEN = "<hex>"
NUM_TOKEN = "<num>"
BLOCK_KEY_PATTERN = r"(blk_-?\d+)"
TOKEN_PATTERN = r"\b\w+\b"
# ---- end of fixed values ----

_U = "(?U)"
# Python's str.split() also treats the ASCII information separators 0x1c-0x1f as
# whitespace; Java's Unicode \s does not, so they are added to the class.
_WS = r"(?U)[\s\x1c-\x1f]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """Collapse every whitespace run to one space and strip both ends."""
    return F.trim(F.regexp_replace(_col(c), _WS, " "))


def mask_line(c) -> Column:
    """lower -> IPv4 to <ip> -> 8+ hex chars to <hex> -> digit runs to <num> -> collapse.

    The order matters: an 8+ digit number is caught by the hex rule first.
    Stripping before lower-casing is folded into the final collapse (it cannot change
    a word boundary inside the line).
    """
    s = F.lower(_col(c))
    s = F.regexp_replace(s, _U + IP_PATTERN, IP_TOKEN)
    s = F.regexp_replace(s, _U + HEX_PATTERN, HEX_TOKEN)
    s = F.regexp_replace(s, _U + NUM_PATTERN, NUM_TOKEN)
    return collapse_ws(s)


def extract_key(c, pattern: str = BLOCK_KEY_PATTERN, group: int = 1) -> Column:
    """First match of ``pattern`` (group ``group``); '' when there is none."""
    return F.regexp_extract(_col(c), _U + pattern, group)


def split_lines(c) -> Column:
    """Split a text blob into lines the way a text reader does (\\n, \\r\\n, \\r)."""
    return F.split(_col(c), r"\r\n|\r|\n")


def normalize_id(c) -> Column:
    """Session / block id normal form: string, stripped, lower-cased."""
    return F.lower(F.regexp_replace(_col(c).cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def label_to_int(c) -> Column:
    """Label text to 0/1: trimmed, lower-cased 'normal'/'anomaly'; numeric 0/1 accepted;
    anything else (and null) becomes 0."""
    s = F.lower(F.trim(_col(c).cast("string")))
    expr = F.when(s == F.lit("normal"), F.lit(0)).when(s == F.lit("anomaly"), F.lit(1))
    num = s.try_cast("double")
    expr = expr.when(num.isNotNull() & (num != 0), F.lit(1)).when(num == 0, F.lit(0))
    return F.coalesce(expr.otherwise(F.lit(None)), F.lit(0)).cast("int")


def tokens(c) -> Column:
    """Unicode word tokens of the lower-cased text, in order (one-char tokens kept)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(_U + TOKEN_PATTERN), F.lit(0))
