"""Queries of this subpackage by name, and the SQL that checks those SQL can express."""

from __future__ import annotations

from .chat import op1_chat_format
from .minhash import op6_minhash
from .mixing import op10_source_mix
from .neighbours import op4_collision_neighbours
from .packing import op7_packing
from .quality import op3_quality_attention
from .secrets import op9_secret_scan
from .sharding import op8_feistel_shards
from .spotsigs import op2_spotsigs, spotsigs_near_classes
from .sql import ORACLE_SQL  # noqa: F401  read through this module
from .toxicity import op5_toxicity_crf

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_spotsigs": op2_spotsigs,
    "op3_quality_attention": op3_quality_attention,
    "op4_collision_neighbours": op4_collision_neighbours,
    "op5_toxicity_crf": op5_toxicity_crf,
    "op6_minhash": op6_minhash,
    "op7_packing": op7_packing,
    "op8_feistel_shards": op8_feistel_shards,
    "op9_secret_scan": op9_secret_scan,
    "op10_source_mix": op10_source_mix,
    "spotsigs_near_classes": spotsigs_near_classes,
}
