"""The same questions on streams of events."""
