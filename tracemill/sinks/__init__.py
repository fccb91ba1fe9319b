"""Where results go beside Spark's own sinks."""
