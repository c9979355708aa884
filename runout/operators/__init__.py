"""Planning operators: DataFrames and Params in, a DataFrame out, no actions inside."""
