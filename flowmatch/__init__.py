"""flowmatch: compare process models and event flows in bulk on Spark.

Model text, nested diagrams or event tables become long node / flow / lane
tables; those become labelled multisets; pairs of models are scored with
frequency-aware dice, jaccard, precision, recall and F1, weighted per section
and overall.  Everything is DataFrame in, DataFrame out.
"""

from flowmatch.session import get_spark, checkpoint_dir, bounded_broadcast

__all__ = ["get_spark", "checkpoint_dir", "bounded_broadcast"]
