"""lodestone: catalogue resolution, enrichment and search as Spark DataFrame operators."""
