"""Scalar functions with the semantics of the analysed language, as column expressions."""
