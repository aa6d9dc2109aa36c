"""Raw log lines -> keyed line table (T2): mask (P1), key (P2), keep keyed lines (P3),
exact 0-based position in input order (P4), and the line timestamp from the
``yyMMdd HHmmss`` prefix when present (Q5: lets sessionizing consume the parser output)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract_key, mask_line
from ..functions.text import BLOCK_KEY_PATTERN
from .ordered import file_positions, grouped_positions, row_index

# fixed value: the timestamp prefix of the source log format
LOG_TS_PATTERN = r"^\s*(\d{6} \d{6})"
LOG_TS_FORMAT = "yyMMdd HHmmss"


def parse_log(lines: DataFrame, text_col: str, order: Sequence, pattern: str = BLOCK_KEY_PATTERN,
              mask_first: bool = False, with_timestamp: bool = True, dense_within: bool = False) -> DataFrame:
    """(session_id, log_key, pos[, timestamp]) for every line carrying a key.

    ``order`` gives the input order (e.g. file path and offset, or document id and line
    number; empty for a table of ``read_text_lines``, whose lines go by file and place in it);
    ``pos`` counts every input line, so dropped lines leave gaps. With
    ``dense_within`` the second order column is a dense 0-based index inside the first
    (line numbers of a document) and positions come from per-group counts. With
    ``mask_first`` the key is searched in the masked line, as the source did (negative
    block ids are then lost); by default it is searched in the lower-cased raw line.
    """
    if not order:
        # text files: one count per file block, no sort of the text
        d = file_positions(lines)
    elif dense_within and len(order) == 2:
        # (group, dense index inside the group): prefix sum over groups, no global sort
        d = grouped_positions(lines, order[0], order[1], "pos")
    else:
        d = row_index(lines, order, "pos")
    masked = mask_line(text_col)
    src = masked if mask_first else F.lower(F.col(text_col))
    cols = [extract_key(src, pattern).alias("session_id"), masked.alias("log_key"), F.col("pos")]
    if with_timestamp:
        raw = F.regexp_extract(F.col(text_col), LOG_TS_PATTERN, 1)
        cols.append(F.when(raw != "", F.try_to_timestamp(raw, F.lit(LOG_TS_FORMAT))).alias("timestamp"))
    return d.select(*cols).where(F.col("session_id") != "")
