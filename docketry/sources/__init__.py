"""Part of the document operators: sources."""
