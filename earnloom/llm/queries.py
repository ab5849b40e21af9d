"""Imports every operator, which registers its query."""

from earnloom.llm import byte_pairs, collocations, contamination, hosts, licenses, mixture, near_dedup, periodic_runs, private_data, quality_rules, ranking, shards, tokens  # noqa: F401
from earnloom.llm.registry import QUERIES, SQL  # noqa: F401
