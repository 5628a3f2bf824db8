"""Block features of event streams."""
