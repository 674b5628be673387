"""Training-data operators.

Every operator is a function from DataFrames to a DataFrame. Nothing outside this
package imports it; the registered queries and their SQL are in ``queries``.
"""
