"""Scenario search and coverage analytics over captions and embeddings, as Spark DataFrame plans."""
