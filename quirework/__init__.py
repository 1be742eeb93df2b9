"""Document intelligence over a whole corpus, written as Spark DataFrame operators."""
