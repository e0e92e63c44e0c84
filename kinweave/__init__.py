"""Pairwise relatedness analytics as Spark DataFrame operators."""
