"""Composed plans: scoring, leaderboards, robustness grids, corpus building."""
