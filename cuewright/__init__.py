"""cuewright: analytics over timed text, written for Spark.

Sub-packages: ``functions`` (column expressions), ``sources`` (readers), ``operators`` (DataFrame to
DataFrame), ``plans`` (queries over the test tables and their SQL), ``streaming`` (resumable runs).
"""
