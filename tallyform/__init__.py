"""tallyform: record analytics over token-level document data, expressed as Spark DataFrame plans."""
