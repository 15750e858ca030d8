"""The stream query."""


def test_stream_query_keeps_its_records(spark, monkeypatch):
    """The record table, two aggregations and a join, is computed once for the fit, the files and the batch path."""
    from tessera.catalog import files

    class Stop(Exception):
        pass

    def fit(records, *args, **options):
        assert records.storageLevel.useMemory and records.storageLevel.useDisk
        raise Stop

    monkeypatch.setattr(files, "fit_scorer", fit)
    try:
        files.score_stream(spark, "/root/testdata/sf0.001")
    except Stop:
        return
    raise AssertionError("the scorer was not fitted")
