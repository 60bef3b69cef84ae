"""lodestar: macro time-series analytics and backtesting on Spark DataFrames."""

from importlib import import_module

__version__ = "0.2.0"

#: What a user needs most, by module; read on first use.
EXPORTS = {
    "sources": ("read_table", "read_csv", "write_csv", "month_last", "month_mean", "calendar", "on_calendar", "as_of", "vintage", "cache_key", "synthetic", "synthetic_target"),
    "sources.vintages": ("panel_as_of", "monthly_as_of"),
    "sources.files": ("read_records", "split_records", "write_partitions", "write_report", "Extracts"),
    "operators.factor_model": ("forecasts", "fold_states", "failures", "importance"),
    "operators.walkforward": ("walk_forward", "hidden_states", "MODELS"),
    "operators.screening": ("screened", "screened_by_fold", "predictive_scale", "grouped", "common_series"),
    "operators.regimes": ("vote", "smoothed"),
    "operators.portfolio": ("positions", "delevered", "swept", "sweep_report", "conviction", "turnover", "costed", "cost_report"),
    "operators.metrics": ("accuracy", "risk", "trading", "diebold_mariano", "clark_west", "bootstrap", "permutation"),
    "operators.combinations": ("combination_report", "by_signal"),
    "plans.reports": ("markdown", "write_markdown"),
}
_WHERE = {name: module for module, names in EXPORTS.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(name)
