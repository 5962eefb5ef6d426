"""Reading and writing of node, edge, text and vector tables."""
