"""tidemark: point-in-time analytics over surveillance and demand series, as Spark DataFrame operators."""
