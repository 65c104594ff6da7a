"""sparkbars: market-bar analytics (features, regimes, labels, exit grids,
KPIs, rules, logs, models) as Spark DataFrame jobs over all symbols at once."""

from .params import DEFAULT, Params  # noqa: F401
