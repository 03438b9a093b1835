"""Operations of a large-scale training-data pipeline, each on plain Spark DataFrames."""
