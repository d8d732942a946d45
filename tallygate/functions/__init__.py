"""Statistics: on plain numbers in :mod:`.numeric`, on columns in :mod:`.columns`."""
