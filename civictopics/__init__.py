"""civictopics: topic analysis of large text collections on PySpark.

Every operator takes and returns DataFrames.  Rows are identified by an explicit ``row_id``;
nothing depends on the order of rows or on partition boundaries.
"""

__version__ = "0.1.0"
