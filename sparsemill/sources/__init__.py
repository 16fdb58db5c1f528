"""Sources and sinks: namespace catalogs, text examples, record caches, model directories, weight differences."""
