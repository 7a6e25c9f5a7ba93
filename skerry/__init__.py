"""skerry: a file-catalog search, content-search and maintenance engine on PySpark."""

__version__ = "0.1.0"
