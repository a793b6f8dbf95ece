"""emberframe: analytics over dictionary-encoded stack-trace profiles, on Spark."""
