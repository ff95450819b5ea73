"""Column functions: text, geography, scores and time.  Each takes and returns Columns, without a Python UDF."""
