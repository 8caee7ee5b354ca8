"""lodestone: document search and retrieval analytics on PySpark."""
