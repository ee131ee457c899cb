"""docgauge: scores how well automated readers can reach, trust and answer from documentation sites.

Every operator is a ``DataFrame -> DataFrame`` function over captured tables; see README.md.
"""
