"""The graph and the plan fragments that operators are made of."""
