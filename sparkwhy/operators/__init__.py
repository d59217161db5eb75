"""DataFrame operators: provenance, joined tables, candidate patterns, scores, rankings."""
