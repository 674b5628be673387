"""skyloom: Spark-first analytics for sky-survey tables and training-data corpora."""
