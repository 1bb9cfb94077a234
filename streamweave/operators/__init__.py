"""The verbs."""

from . import aggregates, filters, joins, programs, projection, reshape, sampling, sinks, statistics, textual, windows  # noqa: F401
from .registry import VERBS  # noqa: F401
