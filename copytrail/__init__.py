"""Document-copy tracing analytics expressed as Spark DataFrame operators."""
