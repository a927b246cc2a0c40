"""Graph operators: each takes a PropertyGraph and gives a DataFrame, a graph or a plain answer."""
