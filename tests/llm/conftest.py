import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A small documents table with nulls, repeated rows and texts, and clashing extra columns."""

    def build(texts, extra=(), **columns):
        rows = []
        for i, t in enumerate(texts):
            row = {"doc_id": i, "text": t, "lang": "en", "source": f"s{i % 3}", "n_chars": None if t is None else len(t)}
            rows.append({**row, **{c: v[i] for c, v in columns.items()}, **{c: i for c in extra}})
        names = DOCS + "".join(f", `{c}` long" for c in extra)
        order = [f.split()[0].strip("`") for f in names.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in order) for r in rows], names)

    return build
