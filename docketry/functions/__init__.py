"""Part of the document operators: functions."""
