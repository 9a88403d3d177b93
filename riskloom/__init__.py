"""riskloom: credit-risk analytics on Spark DataFrames."""
