"""lexframe: contract and text analytics expressed as Spark plans over a DataFrame of documents."""

__version__ = "0.1.0"
