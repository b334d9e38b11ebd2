"""A Spark-first engine that profiles source repositories and prepares text corpora."""
