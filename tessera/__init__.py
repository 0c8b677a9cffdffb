"""tessera: a PySpark engine that compiles, indexes, searches and checks collections of documents."""

__version__ = "0.1.0"
