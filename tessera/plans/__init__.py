"""The registered queries, their SQL, and the pipeline."""
