"""Lodestone: discovery, folding, scoring and ranking of entities as Spark DataFrame jobs."""
