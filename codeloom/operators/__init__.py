"""Reusable DataFrame operators (ranking, graph, division, skew, orphans, ...)."""
