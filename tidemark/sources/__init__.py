"""Readers and writers of market data, and series made from the test tables."""
