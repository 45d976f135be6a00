"""Column builders; all run inside Spark's expressions unless they say otherwise."""
