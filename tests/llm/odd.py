"""A small table with all that is awkward, shared by the tests."""

from __future__ import annotations

#: Names that operators use inside or return, here as columns of the input.
CLASHES = "digest body ident node n key size row shard slot class score signature comp token_ids tie a.b".split()


def schema(extra=CLASHES):
    base = "doc_id long, text string, lang string, source string, n_chars long"
    return base + "".join(f", `{c}` string" for c in extra)


def rows():
    long = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
    texts = [
        (0, "The quick brown fox jumps over the lazy dog near the river bank today"),
        (1, "the QUICK brown fox jumps over the lazy dog near the river bank today"),
        (2, None), (3, ""), (4, "   \n\t "), (5, "one"), (6, "One"), (7, long), (8, long + " end"), (9, "x" * 200_000),
        (10, "The quick brown fox jumps over the lazy dog near the river bank tonight"),
        (11, "café 漢字 \U0001f389 naïve İstanbul"), (12, "a a a a a a a a"), (13, "a a a a a a a a b"),
    ]
    out = [(i, t, "en" if i % 2 else None, [None, "s1", "s2"][i % 3], None if t is None else len(t)) for i, t in texts]
    out.append(out[0])  # a repeated row
    out.append((None, "the text of nobody", None, None, None))
    return out


def table(spark, data=None, extra=CLASHES):
    data = rows() if data is None else data
    return spark.createDataFrame([tuple(r) + ("clash",) * len(extra) for r in data], schema(extra))


def write(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
