"""Second-hand vehicle listing analytics as plain PySpark DataFrame operators."""
