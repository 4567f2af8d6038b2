"""Intermediate and driver tables; see ``lexigraph.sources.scratch``."""

from lexigraph.sources.scratch import materialise, shared_dir, table

__all__ = ["materialise", "shared_dir", "table"]
