"""DataFrame-to-DataFrame steps of the pipeline."""
