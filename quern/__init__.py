"""quern: a multi-model key-value analytics engine on DataFrames.

Keys are columns, commands are functions from DataFrames to DataFrames that
run over all keys at once, and mutations are folds over an ordered log.
"""

__version__ = "0.1.0"
