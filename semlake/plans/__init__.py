"""Query algebra, its two languages, and compilation to DataFrames."""
