"""Transit ridership analytics as Spark DataFrame operators."""
