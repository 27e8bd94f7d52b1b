import pytest

from pitchlytics.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests")


@pytest.fixture
def frame(spark):
    """Build a small frame from a schema string and rows."""

    def build(schema, rows):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def rows():
    """Collect a frame as sorted tuples in the order of the named columns."""

    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((v is None, v) for v in t))

    return collect


@pytest.fixture
def many_slices(spark):
    """Keep small inputs in as many range partitions as a large one would have."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")
