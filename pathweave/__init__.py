"""Association-aware analytics on Spark: a semantic query layer plus data-processing operators."""
