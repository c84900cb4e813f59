"""clusterlens: log and resource-metric analytics for containerised jobs on PySpark."""
