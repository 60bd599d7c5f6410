"""A PySpark engine for curating and evaluating speech and text corpora."""
