"""lexaria: static word embeddings as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` built on the public
Spark SQL / ML / Structured Streaming APIs.  Sub-packages:

- ``functions``  Column-expression helpers (text contract, vector algebra, ordering)
- ``sources``    scans (corpus, vector text formats, binary shards, benchmarks)
- ``sinks``      writers (vector text formats, binary shards, feature batches, stages)
- ``operators``  vocabulary, contexts, pooling, encoding, evaluation, sampling, linear algebra
- ``train``      synchronous large-batch distillation / contrastive / regression steps
- ``streaming``  Structured Streaming variants of the stateful consumers
- ``plans``      derived relations over the test tables and the query catalogue
"""

from lexaria.session import checkpoint_dir, get_spark, ship_package

__all__ = ["get_spark", "checkpoint_dir", "ship_package"]
