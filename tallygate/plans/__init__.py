"""The five kinds of reports: comparison, sequential test, matrix, match plan and power."""
