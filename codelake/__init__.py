"""codelake: code intelligence and corpus preparation as Spark DataFrame programs."""
