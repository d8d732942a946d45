"""Readers of trial and match records, and writers of reports."""
