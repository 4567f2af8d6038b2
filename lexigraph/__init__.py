"""Text indexing, sparse graph algebra and corpus preparation as Spark DataFrame transformations."""
