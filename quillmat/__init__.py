"""Analytics over annotated matrices on Spark: a sparse variables x observations matrix, a table
describing the variables and one describing the observations."""
