"""Table-level transformations: DataFrame in, DataFrame out."""
