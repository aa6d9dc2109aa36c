"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from .audit import OP12_SQL, op12_conversation_audit
from .decontaminate import op6_template_decontamination
from .jaccard import op5_jaccard_forest
from .langid import op2_language_id
from .manifest import OP11_SQL, op11_merkle_manifest
from .mixing import OP9_SQL, op9_hierarchical_mixing
from .pii import op8_contextual_pii
from .preferences import OP3_SQL, op3_preference_pairs
from .quality import OP4_SQL, op4_quality_cascade
from .repeats import op1_repeat_removal
from .secretscan import op13_secret_scan
from .tokens import op7_edited_token_counts
from .warc import OP10_SQL, op10_warc_segments

QUERIES = {
    "op1_repeat_removal": op1_repeat_removal,
    "op2_language_id": op2_language_id,
    "op3_preference_pairs": op3_preference_pairs,
    "op4_quality_cascade": op4_quality_cascade,
    "op5_jaccard_forest": op5_jaccard_forest,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_edited_token_counts": op7_edited_token_counts,
    "op8_contextual_pii": op8_contextual_pii,
    "op9_hierarchical_mixing": op9_hierarchical_mixing,
    "op10_warc_segments": op10_warc_segments,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_audit": op12_conversation_audit,
    "op13_secret_scan": op13_secret_scan,
}

SQL = {
    "op3_preference_pairs": OP3_SQL,
    "op4_quality_cascade": OP4_SQL,
    "op9_hierarchical_mixing": OP9_SQL,
    "op10_warc_segments": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_conversation_audit": OP12_SQL,
}
