"""Order-fulfilment analytics as plain PySpark DataFrame functions.

Every function takes DataFrames and explicit parameters and returns a lazy DataFrame. The layers are
``sources`` (files in, tables out), ``functions`` (column expressions), ``operators`` (skew-safe building
blocks) and ``plans`` (the star schema, the marts and the analyses).
"""
