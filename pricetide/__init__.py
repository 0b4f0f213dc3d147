"""pricetide: catalogue analytics for price-comparison data, expressed as PySpark DataFrame plans."""

__version__ = "0.1.0"
