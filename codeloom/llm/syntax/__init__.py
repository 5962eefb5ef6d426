"""Parsers that tell whether a file is valid in its language."""

from codeloom.llm.syntax.validity import check, file_errors, invalid_files, rates

__all__ = ["check", "file_errors", "invalid_files", "rates"]
