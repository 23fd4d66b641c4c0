"""lantern: retrieval, evaluation and corpus operators as Spark DataFrame plans."""
