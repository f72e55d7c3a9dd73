"""Helpers of the tests in this folder."""


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
