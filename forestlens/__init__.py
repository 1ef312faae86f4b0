"""forestlens: labeled tabular data on Spark: cleaning, encoding, random-forest
pipelines and distributed evaluation (confusion matrices, weighted metrics,
error-attribution reports)."""

__version__ = "0.1.0"
