"""Part of the document operators: operators."""
