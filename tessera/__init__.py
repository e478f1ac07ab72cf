"""PySpark-native analytics over periodic, self-declared reports."""
