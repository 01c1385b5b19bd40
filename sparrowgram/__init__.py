"""sparrowgram: code-intelligence and text-retrieval analytics on PySpark DataFrames."""
