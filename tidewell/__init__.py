"""Panel analytics for PySpark: causal features, targets, alarms and metrics as DataFrame functions."""
