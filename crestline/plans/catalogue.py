"""All registered queries of the library proper."""

from __future__ import annotations

from crestline.plans import alarm_queries, benchmark_queries, control_queries, data_queries, episode_queries, model_queries, report_queries, stream_queries  # noqa: F401
from crestline.plans.registry import ORACLES, QUERIES  # noqa: F401
