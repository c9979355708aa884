"""Operators that turn crawled text into training data. Nothing else in the library imports them."""
