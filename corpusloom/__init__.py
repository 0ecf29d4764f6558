"""Corpusloom: parallel-corpus and training-data pipelines as DataFrame plans."""
