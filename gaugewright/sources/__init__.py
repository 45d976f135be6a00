"""Readers of semi-structured inputs; whatever came over a network is a table here."""
