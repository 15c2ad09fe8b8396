"""Cinderlake: gridded disturbance-regime analytics as plain PySpark DataFrame operators."""
