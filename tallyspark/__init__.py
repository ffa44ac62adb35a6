"""Order settlement at scale, written as plain PySpark DataFrame operators."""
