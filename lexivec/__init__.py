"""lexivec: document analytics, retrieval and evaluation as lazy PySpark DataFrame operators."""
