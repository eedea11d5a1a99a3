"""Lodestone: hybrid retrieval and corpus analytics as lazy Spark plans."""
