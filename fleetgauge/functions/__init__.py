"""Column functions: parsing, text and time helpers built from Spark built-ins."""

from .parse import (
    clamped_int, float_or_null, float_or_zero, strict_int, version_at_least, version_of,
)
from .text import (
    SYSTEM_SCHEMAS, cluster_of_host, contains_fold, dns_suffix, drop_index_ddl, equals_fold,
    first_non_empty, is_user_schema, list_items, or_empty, prefix,
)
from .timing import (
    adjusted_interval, five_second_bucket, instant, picos_to_ms, picos_to_seconds, span_nanos, utc_text,
)

__all__ = [
    "SYSTEM_SCHEMAS", "adjusted_interval", "clamped_int", "cluster_of_host", "contains_fold", "dns_suffix",
    "drop_index_ddl", "equals_fold", "first_non_empty", "five_second_bucket", "float_or_null", "float_or_zero",
    "instant", "is_user_schema", "list_items", "or_empty", "picos_to_ms", "picos_to_seconds", "prefix", "span_nanos",
    "strict_int", "utc_text", "version_at_least", "version_of",
]
