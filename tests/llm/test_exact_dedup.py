import hashlib
import re
from collections import defaultdict

from lodestone.llm import exact_dedup, quality, secrets

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, __sha string, __own int, __id int, __found int, __has boolean"


def plain(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


ROWS = [(1, "a  b"), (9, "a\tb"), (0, "a b "), (5, None), (4, ""), (6, " "), (7, "\n\x0b"), (None, "only"), (None, "a b"), (2, "tie"), (2, "tie"), (2, "other"), (8, "x" * 2_000_000), (10, "x" * 2_000_000), (11, "x y " * 300_000)]


def test_matches_plain_version(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    got = [(r.id, r.keep_id, r.group_size, (r.id == r.keep_id), bytes(r.sha).hex()) for r in exact_dedup.groups(docs).collect()]
    assert sorted(got, key=str) == plain(ROWS)
    assert exact_dedup.groups(docs.limit(0)).count() == 0


def test_deduplicate_keeps_one_row_of_each_text(spark):
    docs = spark.createDataFrame([(i, t, "s", "l", 1, "mine", 2, 3, 4, True) for i, t in ROWS], SCHEMA).repartition(4)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert {(r.__getitem__("__sha"), r.__getitem__("__own"), r.__getitem__("__id")) for r in rows} == {("mine", 2, 3)}
    want = {(k, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()) for i, t in ROWS for k in [i]}
    kept = {(i, sha) for i, _, _, stays, sha in plain(ROWS) if stays}
    assert kept <= want and sorted((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in rows if r.doc_id is not None) == sorted(x for x in kept if x[0] is not None)


def test_clashing_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "password=hunter2!xQ and more", "s", "l", 1, "a", 2, 3, 4, True), (2, None, None, None, None, "b", 5, 6, 7, False)], SCHEMA)
    got = secrets.redacted(docs).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == [tuple(r)[2:] for r in docs.orderBy("doc_id").collect()] and got[1].text is None
    assert [tuple(r) for r in quality.kept(docs, None).orderBy("doc_id").collect()] == [tuple(r) for r in docs.orderBy("doc_id").collect()]
