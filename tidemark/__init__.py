"""tidemark: a PySpark-native engine for numeric readings and events.

Plans are declared with DataFrame, SQL, window and Structured Streaming operations and left to Catalyst.
"""
