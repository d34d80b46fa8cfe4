"""tomeforge: document knowledge and retrieval analytics on PySpark."""
