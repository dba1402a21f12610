"""docledger: business-document text to checked ledgers, as Spark DataFrame transformations."""

__version__ = "0.1.0"
