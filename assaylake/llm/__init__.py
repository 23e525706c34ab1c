"""Training-data operators: one module for each operator, queries and their SQL in ``registry``."""
