"""Data-mining operators for PySpark DataFrames and Structured Streaming.

``sources``    text lines, 2-D points and item streams as DataFrames
``functions``  column expressions (tokens, grid cells, distances, coins)
``plans``      reusable plan shapes (staging, skew-safe joins, positions)
``operators``  word counts, outliers, k-center, frequent items
``streaming``  the item operators over Structured Streaming
"""
