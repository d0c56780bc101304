"""Training-data pipeline operators.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library, so either half can be shipped alone.
"""
