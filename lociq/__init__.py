"""lociq: a Spark-first engine for collections of identified sequences and texts."""
