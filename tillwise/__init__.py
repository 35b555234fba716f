"""Customer revenue analytics on PySpark: RFM features, segments, churn risk and KPIs."""

__version__ = "0.1.0"
