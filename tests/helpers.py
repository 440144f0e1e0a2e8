def same_rows(df, con, sql):
    """Whether a DataFrame and a DuckDB query have the same rows, floats to six places."""
    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return f"{float(v):.6f}"

    result = con.execute(sql)
    names = sorted(df.columns)
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == names
    place = [theirs.index(c) for c in names]
    a = sorted([tuple(plain(r[c]) for c in names) for r in df.collect()])
    b = sorted([tuple(plain(r[i]) for i in place) for r in result.fetchall()])
    assert a == b
