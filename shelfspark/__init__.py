"""Collection analytics as Spark DataFrame operators."""
