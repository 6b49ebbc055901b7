"""Spark-native customer analytics: cleaning, KPI reports, churn datasets,
watchlists, MLlib models, document retrieval and rule-based decisions,
all expressed as DataFrame jobs over whole tables."""

__version__ = "0.1.0"
