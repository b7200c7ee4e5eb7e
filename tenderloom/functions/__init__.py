"""Column -> Column functions: text, numbers, dates, reasons, labels."""
