"""probelake: Spark-native analytics for gap-filling-probe sequencing data."""

__version__ = "0.1.0"
