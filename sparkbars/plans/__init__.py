"""Composed queries (q_* modules), the block layout, and the oracle SQL parts.

Import ``sparkbars.plans.catalog`` to register every named query."""
