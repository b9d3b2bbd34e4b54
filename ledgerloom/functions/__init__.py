"""Column builders: text, money, dates, privacy."""
