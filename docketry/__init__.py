"""Document evidence analytics expressed as Spark DataFrame operators."""
