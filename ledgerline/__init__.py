"""Event-log analytics on PySpark: every state is a rebuildable projection of an append-only log."""

__version__ = "0.1.0"
