"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Each operator lives in a module
of its own, takes a ``documents`` DataFrame and keeps a general interface;
``queries`` derives the registered digest columns from them.
"""
