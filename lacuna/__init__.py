"""Missing-data preparation, imputation and evaluation on Spark DataFrames."""
