"""Assemblage analytics on Spark: a group x label cube, neighbourhoods, indices, trees, clusters and randomisation tests."""
