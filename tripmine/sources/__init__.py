"""Readers for landed mail, messages and flight results."""
