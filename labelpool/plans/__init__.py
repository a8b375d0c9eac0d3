"""Plan shapes shared by the operators: exact cuts, skew-safe lookup, blocked pairs."""
