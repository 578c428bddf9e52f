"""Scalar functions: tags, ids, text; codecs, content blocks and cryptography behind Arrow UDFs."""
