"""Column expressions: text, time, priority, structured data and parsers."""
