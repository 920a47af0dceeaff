"""daybook: accounting analytics as ordinary Spark plans."""
