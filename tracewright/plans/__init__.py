"""Registered queries: the engine's operators applied to whole tables."""
