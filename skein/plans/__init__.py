"""Queries of the engine's own operators, bound to the driver's tables, with their oracle SQL."""
