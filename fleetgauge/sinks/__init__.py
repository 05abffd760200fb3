"""Writers: the Parquet lake and message envelopes."""

from .envelopes import TOOLS, TOPICS, envelopes, payloads, run_tools, topic_of, union_envelopes, write_envelopes, write_report
from .lake import compact_lake, object_store_settings, sized, write_lake

__all__ = [
    "TOOLS", "TOPICS", "compact_lake", "envelopes", "object_store_settings", "payloads", "run_tools", "sized",
    "topic_of", "union_envelopes", "write_envelopes", "write_lake", "write_report",
]
