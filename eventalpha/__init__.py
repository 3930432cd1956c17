"""Event studies on text and market data as Spark jobs."""
