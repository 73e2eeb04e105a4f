"""Clinical-document analytics as PySpark DataFrame functions."""
