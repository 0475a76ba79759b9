"""Spark-native retrieval analytics: lexical, vector and hybrid top-k over DataFrames."""
