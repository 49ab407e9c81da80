"""A Spark engine for normativity, deviance and diversity of scored text collections."""
