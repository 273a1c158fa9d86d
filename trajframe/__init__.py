"""trajframe: episodic trajectory data as Spark DataFrame plans."""
