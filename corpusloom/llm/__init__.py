"""Training-data operators: a self-contained subpackage that nothing else in the library imports."""
