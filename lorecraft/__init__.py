"""Lorecraft: text corpora to knowledge graphs and instruction data, on Spark DataFrames."""
