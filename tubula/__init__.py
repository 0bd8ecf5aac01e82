"""Analytics for cohorts of tubular anatomy on Spark DataFrames."""
