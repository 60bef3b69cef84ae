"""Queries over the test tables, one for each operator, with their SQL."""

from . import frames, models, outlook, points, statistics, strategies

QUERIES = {**frames.QUERIES, **strategies.QUERIES, **statistics.QUERIES, **outlook.QUERIES, **models.QUERIES, **points.QUERIES}
ORACLES = {**frames.ORACLES, **strategies.ORACLES, **statistics.ORACLES, **outlook.ORACLES, **models.ORACLES, **points.ORACLES}
