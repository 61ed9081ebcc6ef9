"""framewright: PySpark-native preparation, scoring and curation of clip question-answering data."""

__version__ = "0.1.0"
