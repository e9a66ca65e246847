"""Column builders: text, money, dates, keys."""
