"""casemill: case-record analytics as plain PySpark functions (DataFrame in, DataFrame out)."""
