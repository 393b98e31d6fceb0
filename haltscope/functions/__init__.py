"""Column functions: cleaning, dates, text and merge rules."""
