"""caseflow: case surveillance over free-text visit notes, written as Spark jobs."""

__version__ = "0.1.0"
