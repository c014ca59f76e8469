"""gleaner: similarity retrieval and feature analytics on PySpark."""
