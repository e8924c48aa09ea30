"""quern: Spark-first curation, splitting, sampling, packing and scoring of speech and text corpora."""
