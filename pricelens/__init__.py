"""pricelens: parts-price marts and repair-estimate checks as Spark DataFrame plans."""

__version__ = "0.1.0"
