"""tallyloom: reconcile vendor statements with an internal ledger as Spark DataFrame jobs."""

__version__ = "0.1.0"
