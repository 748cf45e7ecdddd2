"""Operators for training-data pipelines. Nothing else in the library imports
this subpackage; each operator is a module with its own general interface."""
