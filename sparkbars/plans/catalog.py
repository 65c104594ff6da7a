"""Importing this module registers every named query."""

from . import q_analysis, q_features, q_grid, q_io, q_labels, q_ml, q_wide  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
