"""Stand-in entities: the configuration graph played by the test tables."""
