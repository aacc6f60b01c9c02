"""corvello: a document-corpus analytics engine written as Spark DataFrame pipelines."""
