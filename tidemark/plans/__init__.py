"""Whole plans: the engine's calls, and the registered queries with their SQL."""
