"""Graph operators, one module for each family."""
