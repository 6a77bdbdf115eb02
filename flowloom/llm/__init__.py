"""Operators for preparing language-model training data, one module each.

``queries`` registers one ``opN_<name>`` query per operator; nothing else in the library imports
this package.
"""
