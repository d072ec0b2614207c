"""Column expressions: text, keys, money, dates, labels."""
