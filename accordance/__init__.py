"""Agreement analytics between two uncertain measurements, expressed as Spark plans."""
