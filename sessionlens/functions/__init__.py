"""Column-level building blocks (all JVM-side built-ins, no Python UDFs)."""

from .text import (  # noqa: F401
    BLOCK_KEY_PATTERN, mask_line, extract_key, normalize_id, label_to_int, tokens,
    collapse_ws, split_lines,
)
from .columns import (  # noqa: F401
    normalize_headers, require_columns, first_present, backfill_key, coalesce_cast,
    duration_seconds, epoch_micros, from_epoch_micros, parse_timestamp, null_normalised_timestamp, TEXT_COLUMN_CANDIDATES,
)
