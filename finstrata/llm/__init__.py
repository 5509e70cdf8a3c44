"""Training-data operators: each module holds one operator on DataFrames; ``queries`` registers them."""
