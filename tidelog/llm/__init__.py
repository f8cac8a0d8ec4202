"""Training-data operators on documents and pages; nothing outside imports this."""
