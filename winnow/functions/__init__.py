"""Column functions: text, spans and terms. No UDFs."""
