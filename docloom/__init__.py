"""docloom: a Spark-first analytics engine for document libraries."""
