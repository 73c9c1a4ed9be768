"""Operators for large text corpora: ten jobs over tables of documents, each on Spark.

Nothing else in the library imports this package.  An operator takes a DataFrame and the names of
its id and text columns, selects those columns alone (further columns, whatever their names, are
neither read nor returned) and treats a null text as an empty one unless it says otherwise.
"""
