"""Column functions: DataFrame expressions without joins or shuffles of their own."""
