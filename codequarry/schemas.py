"""Canonical schemas and the thresholds of all rules.

Every table carries ``repo_id``, so one job covers many repositories. Columns that an operator
does not name pass through or are ignored; NULL stands for "unknown" (times, coverage).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

FILES = (
    "repo_id string, path string, is_file boolean, ext string, content string, size bigint, last_mod timestamp, "
    "churn int, ownership double, author_count int, primary_author_last_commit timestamp, line_coverage double"
)
COMMITS = "repo_id string, commit_id string, email string, ts timestamp, path string"
SYMBOLS = "repo_id string, seq bigint, name string, type string, line int, end_line int, file_path string"
EDGES = "repo_id string, src string, dst string, rel string"
NODES = "repo_id string, key string, node_type string, name string, type string, path string, pagerank double, community_id bigint"
FUNCTIONS = (
    "repo_id string, path string, ext string, name string, start_line int, end_line int, nloc int, cyclomatic int, "
    "max_nesting int, bumpy boolean, params array<string>"
)
MARKERS = "repo_id string, file string, type string, severity string, message string, line int, deduction double, category string, suggestion string"
COVERAGE = "repo_id string, key string, pct double"

# Score categories and the most that each may deduct (others are not capped).
CATEGORY_CAPS = {
    "structural_complexity": 3.5,
    "size_api_complexity": 2.0,
    "duplication": 1.5,
    "test_coverage": 2.0,
    "organizational_risk": 1.0,
    "dead_code": 1.0,
}


@dataclass(frozen=True)
class Params:
    """Thresholds; ``as_of`` replaces the wall clock in every rule that looks at age."""

    as_of: dt.datetime = dt.datetime(2001, 8, 1)
    token_bloat: float = 50.0
    phantom_churn: int = 5
    phantom_ownership: float = 0.5
    damping: float = 0.85
    resolution: float = 1.0
    rounds: int = 10
    brain_nloc: int = 50
    brain_cyclomatic: int = 15
    brain_nesting: int = 4
    brain_top: float = 0.10
    nesting: int = 4
    complex_cyclomatic: int = 9
    primitive_params: int = 6
    window: int = 6
    stride: int = 3
    similarity: float = 0.80
    active_days: int = 90
    active_factor: float = 1.5
    untested_churn: int = 10
    untested_top: float = 0.20
    untested_below: float = 20.0
    gap_below: float = 60.0
    untested_deduction: float = 1.5
    gap_deduction: float = 0.5
    congestion_authors: int = 5
    congestion_deduction: float = 0.5
    recent_days: int = 90
    loss_days: int = 180
    loss_churn: int = 5
    loss_deduction: float = 0.5
    dead_code_deduction: float = 0.1
