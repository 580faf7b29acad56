"""Where log lines come from and where log rows are kept."""
