"""SQL statements that state the same results for another engine."""
