"""Column functions: coercion, standardisation, text and date features."""
