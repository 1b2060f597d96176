"""Operators for preparing training text: encoding, scoring, filtering, de-duplication, mixing."""
