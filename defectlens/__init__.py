"""Software-defect analytics as Spark jobs: DataFrames and Columns in, DataFrames and Columns out."""
