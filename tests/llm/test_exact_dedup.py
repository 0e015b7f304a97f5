import hashlib
import re
from collections import defaultdict

from eventlens.llm.exact_dedup import drop_exact_copies, exact_groups
from tests.llm.data import empty_docs, odd_docs


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def test_groups_match_brute_force(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = sorted(
        (str(i), str(min((x for x in groups[t] if x is not None), default=None)), len(groups[t]),
         hashlib.sha256(t.encode()).hexdigest()) for i, t in rows
    )
    got = exact_groups(docs, digests=True).collect()
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.digest) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_drop_keeps_columns_and_one_row_each(spark):
    docs = odd_docs(spark)
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert 6 in {r.doc_id for r in rows if norm(r.text) == "a b"}  # not the row without an id
    texts = [norm(r.text) for r in rows]
    assert sorted(texts) == sorted({norm(r.text) for r in docs.collect()})


def test_empty(spark):
    assert exact_groups(empty_docs(spark)).count() == 0
    assert drop_exact_copies(empty_docs(spark)).count() == 0
