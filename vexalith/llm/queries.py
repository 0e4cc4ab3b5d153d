"""The queries of this subpackage; none has an SQL twin (their tests are in tests/llm)."""

from __future__ import annotations

from .clusters import p5_clusters, p5_found
from .history import p4_batches, p4_found
from .leaks import p7_found
from .nearduplicates import p1_found, p1_groups
from .neighbours import p2_found
from .pii import p8_found, p8_redacted
from .subset import p3_subset
from .tokenize import p6_ids

QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p3_subset": p3_subset,
    "p4_found": p4_found,
    "p4_batches": p4_batches,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}
ORACLE: dict[str, str] = {}
