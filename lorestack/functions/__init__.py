"""Functions of the knowledge-base engine: Columns on text and vectors, and sequential walks as pandas functions."""
