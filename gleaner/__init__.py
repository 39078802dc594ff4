"""gleaner: ranked evidence retrieval and the analytics around it, as Spark DataFrame operators."""
