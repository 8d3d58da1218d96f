"""Analytics on sequence reads, k-mers, pileups and assemblies with PySpark DataFrames."""
