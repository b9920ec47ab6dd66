"""quarry: Spark-native operators for open-domain question-answering data work.

Layout
------
functions/   Column -> Column expressions (text cleaning, tokens, hashing)
operators/   DataFrame -> DataFrame operators (dedup, chunking, indexes,
             retrieval, decoding, evaluation, reports, profiles)
sources/     readers and writers (corpus JSON, QA splits, index tables, sinks)
plans/       derived fixtures over the driver tables and end-to-end flows
streaming/   (no streaming operators: the reference has none, see README)
"""

__all__ = ["session"]
