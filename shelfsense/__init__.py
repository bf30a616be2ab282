"""Shop behaviour analytics as Spark jobs: statistics, similarity, suggestions, log streams."""
