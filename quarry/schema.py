"""The governed model's columns and its fail-closed conversions.

Times are epoch seconds (BIGINT). Arrays are never null: an empty visibility
is seen by nobody, an empty tag list is outside every bound scope.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNKS = "tenant string, id long, source string, document_id long, seq int, content string, visibility array<long>, confidentiality int, tags array<string>, kind string, valid_from long, valid_to long"
FACTS = "tenant string, source string, entity_id string, field string, value string, valid_from long, valid_to long, superseded_by long, arrival long"
ACTIONS = "tenant string, action_id long, actor string, action_type string, entities array<string>, summary string, occurred_at long, visibility array<long>, confidentiality int"
EVIDENCE = "id string, left_ref string, right_ref string, tier int, method string, key_kind string, key_value string, polarity int, valid_from long, valid_to long"

PUBLIC, INTERNAL, CONFIDENTIAL, RESTRICTED = range(4)
#: Labels of where an access rule came from; any other is read as the last.
ACL_LABELS = ("mirrored", "declared", "derived", "writer-scoped", "inherited", "default", "admin-assigned")


def confidentiality(c: Column) -> Column:
    """A stored class as 0 to 3; anything else is the strictest."""
    return F.when(c.between(PUBLIC, RESTRICTED), c).otherwise(F.lit(RESTRICTED))


def acl_label(c: Column) -> Column:
    return F.when(c.isin(*ACL_LABELS), c).otherwise(F.lit(ACL_LABELS[-1]))
