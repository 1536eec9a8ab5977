"""Semi-structured documents on Spark: parse, validate, navigate and convert, one document per row."""
