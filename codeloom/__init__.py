"""Code-graph analytics on Spark DataFrames.

Source code, or any data of the same shape, is a property graph: one DataFrame
of nodes, one of edges.  Every operator takes DataFrames and returns a
DataFrame; nothing is executed until the caller asks for rows.
"""
