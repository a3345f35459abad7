"""Lamplight: semi-structured text analytics and hybrid search as Spark DataFrame operators."""
