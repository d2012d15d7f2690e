"""Comparing rows whatever their order."""
from collections import Counter


def counted(df_or_rows):
    return Counter(df_or_rows if isinstance(df_or_rows, list) else [tuple(r) for r in df_or_rows.collect()])
