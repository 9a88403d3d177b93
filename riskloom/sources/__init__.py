"""Sources and sinks: the loan fixture, CSV/JSON/text readers, model and metrics artifacts."""
