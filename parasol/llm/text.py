"""Byte tables for text that Python reads."""

#: A-Z to a-z, every other byte as it is.
FOLD_CASE = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
