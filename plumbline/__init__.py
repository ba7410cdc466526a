"""plumbline: tabular analytics, model evaluation and data checks as Spark plans."""
