"""Part of the document operators: streaming."""
