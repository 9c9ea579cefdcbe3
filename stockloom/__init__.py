"""Supply-chain analytics expressed as Spark DataFrame plans.

``sources``    typed tables, readers, keyed writers
``functions``  column expressions (keys, units, text, predicates)
``operators``  reusable relational building blocks that stay balanced under skew
``plans``      the query surface: views, documents, search, quality checks and bulk jobs
``streaming``  Structured Streaming forms of the ledger, counters and document refresh
"""
