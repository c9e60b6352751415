"""Training-data operators: mixing, dedup, PII surrogates, chat formatting,
quality rules, WARC bundles, HTML extraction, packing and language id.

Nothing else in ``tabsight`` imports this subpackage."""
