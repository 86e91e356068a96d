"""All queries of this subpackage and their SQL."""

from functools import wraps

from graphloom.sources.ship import ship

from . import bpe, bwt_dedup, cap_filters, collision_ann, mixing, pii, simhash, token_counts, toxicity, warc

MODULES = (toxicity, bpe, cap_filters, token_counts, warc, collision_ann, bwt_dedup, simhash, pii, mixing)


def _shipped(f):
    @wraps(f)
    def query(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return query


QUERIES = {name: _shipped(f) for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
