"""Plain SQL twins of the registered queries, for checking them in another engine."""
