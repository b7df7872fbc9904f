"""Training-data operators over the ``documents`` and ``embeddings`` tables."""
