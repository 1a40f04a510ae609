"""catalograph: catalogue ambiguity analytics as lazy Spark DataFrame plans."""
