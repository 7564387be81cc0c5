"""daymark: per-subject observation analytics expressed as Spark DataFrame plans."""
