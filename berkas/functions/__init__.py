"""Functions from Column to Column, inside whole-stage code generation."""
