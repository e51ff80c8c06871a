"""Brindle: hybrid retrieval, its evaluation and corpus preparation as Spark DataFrame plans."""
