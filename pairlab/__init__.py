"""pairlab: data work around data-to-text generation, expressed as Spark jobs.

Subpackages
-----------
sources    readers and writers of paired text, run records and caption sets
functions  column expressions (tokenisers, n-grams, MR parsing) that stay JVM-side
operators  DataFrame -> DataFrame operators (cleaning, overlap, scores, profiling, runs)
plans      the fixture views over the driver tables and the query catalog
streaming  incremental corpus scores with Structured Streaming
"""

__all__ = ["session"]
