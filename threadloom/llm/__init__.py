"""Training-data operators: ten stand-alone components over document, page and vector tables.

Nothing else in the library imports this subpackage, and it imports nothing from the rest of it.
"""
