"""Event-log analytics as Spark DataFrame jobs.

An event log is a DataFrame with the columns ``case_id, activity, ts, seq``
(plus an optional ``ord`` and any event attributes); a case table has one row
per ``case_id``.  Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
