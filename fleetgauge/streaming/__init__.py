"""The collector's loop as Structured Streaming queries."""

from .cells import CellTable
from .findings import StreamedFindings, stream_findings
from .lake import LakeStream, stream_to_lake
from .rates import CounterSteps, stream_counter_steps
from .tail import EventTail, stream_tail
from .waits import WaitSummaries, stream_wait_summary

__all__ = ["CellTable", "CounterSteps", "EventTail", "LakeStream", "StreamedFindings", "WaitSummaries", "stream_counter_steps",
           "stream_findings", "stream_tail", "stream_to_lake", "stream_wait_summary"]
