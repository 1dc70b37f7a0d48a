"""All registered queries of the engine and the DuckDB SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import answers, conversations, grading, repetition, rewards
from .operators import advantages, arrays, balance, dispatch, frame, frame_queries, metrics, ragged, token_queries, validation
from .plans import agents, curation, datasets, rows, shape_queries
from .sources import round_trips, steps, tables
from .streaming import samples, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for module in (advantages, agents, answers, arrays, balance, conversations, curation, datasets, dispatch, frame, frame_queries, grading, metrics, ragged, repetition, rewards, round_trips, rows, samples, shape_queries, steps, tables, token_queries, turns, validation):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
