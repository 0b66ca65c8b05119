"""Archives, packages and compressed streams as typed, verified Spark tables."""
