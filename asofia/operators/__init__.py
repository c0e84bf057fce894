"""Table transformations: every function takes and returns DataFrames."""
