"""Corpus-scale operators for language-model training data.

Self-contained: the rest of the library never imports this package.  Every
operator takes DataFrames, keeps its decisions exact, and writes what must
outlive a stage only to the folder named by ``spark.checkpoint.dir``.
"""
