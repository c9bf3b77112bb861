"""Phishing analytics on Spark: corpus preparation, URL features, models and e-mail scoring."""

__version__ = "0.1.0"
