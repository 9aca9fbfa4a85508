"""Related notes by sets of hashtags against the SQL that they stand for."""

import random

from strandline.operators import related
from strandline.plans import catalog  # noqa: F401
from strandline.plans.template import REGISTRY, Operator

from .helpers import rows_of_spark


def test_related_notes_as_sql_has_them_without_a_row_for_each_pair(spark):
    rng, ids = random.Random(3), range(1, 701)
    notes = spark.createDataFrame([(i, i % 23, rng.randrange(300)) for i in ids], "id long, pubkey long, created_at long")
    tags = spark.createDataFrame([(i, t) for i in [*ids, 9001] for t in rng.sample(["a", "b", "c-1", "d_2"], rng.choice([0, 1, 1, 2, 3]))], "event_id long, tag string")
    best = spark.createDataFrame([(i % 23, i, rng.randrange(40)) for i in ids if i % 3], "pubkey long, id long, engaged long")
    reposts = spark.createDataFrame([(rng.choice(ids[:350]), rng.choice(ids[350:])) for _ in range(90)], "id long, target_id long").distinct()
    edges = spark.createDataFrame([(i, rng.randrange(1, i), i % 9 == 0) for i in ids if i > 1], "child long, parent long, parent_missing boolean")
    frames = {"notes": notes, "norm_tag_hashtags": tags, "best_of_author": best, "repost_notes": reposts, "thr_edges": edges}
    sql = Operator("disc_related_notes", "", REGISTRY["disc_related_notes"].sql)(**frames)
    found = related.related_notes(**frames)
    assert rows_of_spark(found) == rows_of_spark(sql)
    assert dict(found.dtypes) == dict(sql.dtypes)
