"""Table operators: profile, normalise, exact and fuzzy dedup, clusters, audits."""
