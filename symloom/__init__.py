"""symloom: program-graph analytics and code-corpus preparation on PySpark."""

__version__ = "0.1.0"
