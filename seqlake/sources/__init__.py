"""Inputs: sequence views of tables, and file formats."""
