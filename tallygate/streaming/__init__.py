"""Sequential tests over streams of trials."""
