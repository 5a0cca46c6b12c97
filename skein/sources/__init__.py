"""Readers of transcripts, markdown folders, registries and trees, and the writers beside them."""
