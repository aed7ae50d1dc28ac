"""quarrylens: PySpark-native analytics over audit data of marked, machine-made code."""

__version__ = "0.1.0"
