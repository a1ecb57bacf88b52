"""Training-data operators (text, pages, conversations) and their queries."""
