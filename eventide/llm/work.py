"""Intermediate tables of the operators: those of the library, in the folder that every executor shares."""

from eventide.sources.tables import discard, made, materialize, shared_dir, sweep

__all__ = ["discard", "made", "materialize", "shared_dir", "sweep"]
