"""Plans: the derived tables of one input folder, the registered queries and
their oracle SQL."""
