"""Analytics over interlinear-annotated text corpora, expressed as Spark DataFrame jobs."""
