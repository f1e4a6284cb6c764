"""Collection, cleaning and sales analytics for file-based data platforms, on Spark.

Operators are functions ``(DataFrame, parameters) -> DataFrame``.  They stay lazy unless
their docstring says otherwise, and leave the physical strategy to Catalyst and AQE.
"""

from forecourt.session import build_session

__all__ = ["build_session"]
