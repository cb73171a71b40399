"""Point-hazard analytics expressed as Spark DataFrame operations."""
