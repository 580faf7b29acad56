"""Query operators on the log table: parsing, filters, pages, aggregates."""
