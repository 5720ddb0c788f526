def test_modules_import():
    import stratafs.operators.diff  # noqa: F401
    import stratafs.operators.feed  # noqa: F401
    import stratafs.operators.reports  # noqa: F401
    import stratafs.operators.search  # noqa: F401
    import stratafs.sources.gate  # noqa: F401
    import stratafs.sources.store  # noqa: F401
    import stratafs.sources.walk  # noqa: F401
    import stratafs.streaming.apply  # noqa: F401
    import stratafs.streaming.debounce  # noqa: F401
