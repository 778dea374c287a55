"""Readers and writers of records, features, requests and hits."""
