"""Readers and writers. All of them return or take DataFrames; parsing happens in native expressions."""
