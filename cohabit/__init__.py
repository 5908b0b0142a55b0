"""Co-occurrence analytics over large abundance tables, as Spark jobs."""
