"""Readers of document files: format checks, text extraction, directory scans and a text cache."""
