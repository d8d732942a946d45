"""Relational operators over trial and match records, and the resampling built on them."""
