"""Training-data operators over the corpus tables (documents, pages, labels,
conversations).  Nothing else in the library imports this subpackage."""
