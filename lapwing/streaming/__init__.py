"""Jobs over arriving documents and events."""
