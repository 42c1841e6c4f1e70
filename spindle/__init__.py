"""Graph analytics on Spark DataFrames.

``sources`` reads typed edge lists, ``operators`` builds undirected multigraphs
and computes degrees, adjacency, partitions and PageRank, ``functions`` holds
strict same-type scalar operators, ``streaming`` keeps graph figures over an
edge stream, and ``plans`` registers queries with their SQL equivalents.
"""
