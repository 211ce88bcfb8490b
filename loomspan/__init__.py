"""loomspan: analytics over chat traffic and text corpora, built on Spark DataFrames."""
