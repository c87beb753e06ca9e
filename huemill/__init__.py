"""huemill: a PySpark engine for extracting, reconciling and searching product-colour catalogues."""

__version__ = "0.1.0"
