"""Column-level functions: fixed texts, template rendering, narratives."""
