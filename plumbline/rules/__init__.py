"""Detection rules as relational plans: facts in, findings out."""
