"""Pool-rating analytics as Spark jobs: ingest, measures, ranks, ratings, labels, documents."""
