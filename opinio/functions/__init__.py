"""Column functions: text, dates, versions, rating classes, arithmetic."""
