"""Training-data operators; nothing else in the library imports this subpackage."""

from . import bpe, exact_dedup, html_main, importance, media, packing, pii, prefix_trie, set_join, sharding, simhash, warc, whitening

MODULES = (exact_dedup, packing, simhash, html_main, pii, sharding, media, warc, importance, bpe, whitening, prefix_trie, set_join)

QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
