"""tessera: a PySpark-native document retrieval and grounding engine."""
