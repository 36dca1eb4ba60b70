"""Physical building blocks shared by the operators: ids, lineage cuts, pair joins."""
