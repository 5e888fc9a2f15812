"""factloom: dated facts kept in Markdown notes, as Spark tables and batch queries."""

__version__ = "0.1.0"
