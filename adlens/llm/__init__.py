"""Training-data pipeline operators (corpus curation at scale) on Spark."""
