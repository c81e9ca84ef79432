"""Spark-native analytics over technology-signal scans.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame transformations), ``sources`` (readers, writers and input contracts),
``streaming`` (incremental sinks), ``plans`` (registered queries with their
oracle SQL) and ``llm`` (training-data operators, optional).
"""
