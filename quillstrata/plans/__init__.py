"""Plan shapes shared by the operators: skew-proof lookups, ordered fills, whole jobs."""
