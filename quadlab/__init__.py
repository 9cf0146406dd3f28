"""Label-quality and detection-evaluation operators for quad-labelled samples, on Spark DataFrames."""
