"""Matched-date (time-stratified case-crossover) analytics on Spark DataFrames."""
