"""inkloom: document processing on Spark DataFrames.

The core package holds the text, segmentation, terminology, provenance,
task-graph, quality and publication operators.  ``inkloom.llm`` holds the
operators for training-data preparation; nothing outside it imports it.
"""

__version__ = "0.1.0"
