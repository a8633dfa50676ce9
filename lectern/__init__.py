"""A PySpark library for multi-version, verse-keyed text corpora whose words carry numeric lexicon tags."""
