"""Training-data operators over a table of documents (doc_id, text, ...)."""
