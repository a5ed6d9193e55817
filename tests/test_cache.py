from pyspark.sql import types as T

from ledgerloom.sources.cache import BlockCache


def test_cache_replays_what_is_contiguous(spark, tmp_path):
    schema = T.StructType([T.StructField("number", T.LongType())])
    cache = BlockCache(spark, str(tmp_path), schema)
    blocks = lambda *n: spark.createDataFrame([(x,) for x in n], schema)
    cache.store("q", 0, blocks(0, 1, 2), 0)
    assert cache.replay("q", 0)[1] == 1
    cache.store("q", 1, blocks(1, 2, 3, 4), 3)
    cache.store("q", 9, blocks(9), 20)
    cache.store("q", 4, blocks(4), None)
    found, after = cache.replay("q", 0)
    assert (sorted(r.number for r in found.collect()), after) == ([0, 1, 2, 3], 4)
    assert cache.replay("q", 2)[1] == 2
    assert cache.replay("other", 0)[1] == 0
    cache.store("q", 4, blocks(4, 5, 6, 7, 8), 8)
    assert cache.replay("q", 0)[1] == 10
