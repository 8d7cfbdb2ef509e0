"""Quire: document understanding and hybrid retrieval as Spark plans."""
