"""Panel analytics on Spark: leak-safe features, universes, labels and evaluation for (symbol, date) tables."""
