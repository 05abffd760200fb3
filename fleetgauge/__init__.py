"""Fleet-scale analytics over database telemetry, on Spark."""

from .operators import *  # noqa: F401,F403
from .rules import CATEGORIES, RULES, Case, Rule, rule  # noqa: F401
from .session import build_session, run_dir, shared_dir  # noqa: F401
from .sinks import *  # noqa: F401,F403
from .sources import *  # noqa: F401,F403
