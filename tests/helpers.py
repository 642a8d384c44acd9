"""What several test modules use."""


def rows(df, *order):
    """Collected rows as dicts, sorted."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[c]) for c in order)) if order else out
