"""Tandem-repeat consensus engine on Spark DataFrames.

Sub-packages: ``sources`` (file formats), ``functions`` (column functions), ``operators`` (relational, graph and alignment
operators), ``plans`` (pipelines and the registered queries), ``streaming`` and ``llm`` (training-data operators, optional).
"""

__version__ = "0.1.0"
