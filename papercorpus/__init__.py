"""Prepare and evaluate corpora of short texts paired with long ones on Spark.

Every function takes and returns DataFrames or Columns; there is no global
session.  ``functions`` holds column expressions, ``sources`` readers and
writers, ``operators`` table-level steps, ``plans`` whole workflows built from
them, ``streaming`` the row-wise steps over arriving files.
"""
