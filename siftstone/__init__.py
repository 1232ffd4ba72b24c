"""siftstone: structured-document retrieval and grounded-answer analytics on PySpark."""
