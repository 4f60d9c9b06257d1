"""sendero: explainable recommendation analytics on Spark DataFrames.

Profiles and user-item interactions are cleaned, turned into narratives and
vectors, and matched both ways (user -> items not yet consumed, item -> users
not yet reached) as distributed blocked similarity joins with exclusion and
per-group top-k.  Around that core: prompt assembly for a caller-supplied
generator, response parsing and validation, vector index tables with keyed
merges, and offline evaluation.
"""

from sendero.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
