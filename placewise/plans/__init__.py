"""The catalogue of queries over the driver tables, and their twins in SQL."""
