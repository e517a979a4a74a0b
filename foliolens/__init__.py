"""foliolens: portfolio-sequence analytics expressed as Spark DataFrame functions."""
