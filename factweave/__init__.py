"""factweave: Spark-native operators for integrating partial, conflicting and ambiguous facts."""

__version__ = "0.1.0"
