"""trawl: search, ranking, retrieval evaluation and ingestion as Spark DataFrame transforms."""
