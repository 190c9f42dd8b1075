"""logtide: archive and query time-stamped log events with PySpark DataFrames."""
