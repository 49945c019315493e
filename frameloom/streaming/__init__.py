"""Order-dependent operators: step functions, run over sorted partitions in batch and over keyed state in streams."""
