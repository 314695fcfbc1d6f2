"""Imports every query module so that the registry is complete."""

from tidemark.plans import q_bars, q_data, q_features, q_futures, q_more, q_ops, q_portfolio, q_screen, q_stats, q_streaming, q_trades  # noqa: F401
from tidemark.plans.registry import QUERIES, oracles  # noqa: F401
