"""Readers that turn sheets, feeds, pages and stored documents into typed DataFrames."""
