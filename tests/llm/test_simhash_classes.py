import random

from matchloom.llm import near_copies
from matchloom.session import local_session


def test_near_copies_are_found_by_their_simhash_class(monkeypatch):
    """Without any MinHash key the classes alone bring near copies together; the shingle sets still decide."""
    spark = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})
    monkeypatch.setattr(near_copies, "band_keys", lambda least: [])
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    phrase = "one two three four five " * 80
    tails = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(25)) for _ in range(2)]
    table = [(1, long), (2, f"{long} end"), (3, long.upper()), (4, phrase + tails[0]), (5, phrase + tails[1]), (6, None), (7, ""), (8, "other words")]
    rows = near_copies.marked(spark.createDataFrame(table, "c0 long, c1 string"), "c1", 5)
    classes = {r.node: r.key for r in near_copies.class_keys(rows, near_copies.DISTANCE).collect()}
    of = {r.c0: classes.get(r._node) for r in rows.collect()}
    assert of[1] == of[2] == of[3] and of[4] == of[5] and of[6] is of[7] is None
    kept = near_copies.one_of_each(spark.createDataFrame(table, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 8]
