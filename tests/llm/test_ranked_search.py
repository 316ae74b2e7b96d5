import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import queries
from faultline.llm.ranked_search import Shard, _lists, build_index, impacts, inverted, ranked_search
from tests.llm.corpus import documents, prose
from tests.llm.test_text_operators import LOWER

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, k=50):
    """The ranking of every row of items, by scoring all documents."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, df = sum(n for *_, n in bags), Counter(t for _, b, _ in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * d + 1))) for t, d in df.items()}
    out = Counter()
    for item, text in items:
        asked = set(terms(text)) & set(df)
        scored = []
        for i, b, n in bags:
            m = 50 + 50 * n * len(bags) // total
            s = sum(weight[t] * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in asked if t in b)
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        for r, (s, known, i) in enumerate(sorted(scored)[:k]):
            out[(item, r + 1, i if known else None, -s)] += 1
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    common = [prose(rng, 1) for _ in range(300)]
    docs = [(i, t) for i, t, *_ in documents()] + [(100 + i, " ".join(rng.choices(common, [1 / (k + 1) for k in range(300)], k=rng.randint(1, 80)))) for i in range(900)]
    docs += [docs[200]] * 70 + [(None, docs[210][1]), (None, docs[211][1]), (5, "Rare-term ÄÖ_x9 the_end"), (6, "rare term äÖ x9")]
    items = [(k, " ".join(rng.choices(common, k=rng.randint(1, 30)))) for k in range(20)] + [(30, None), (31, ""), (32, "..."), (33, "neverseen"), (34, "RARE TERM ÄÖ"), (None, common[0]), (3, common[1]), (3, common[1])]
    return docs, items


@pytest.mark.parametrize("shard_bytes,query_block", [(1 << 25, 512), (3000, 4)])
def test_search(written, corpus, shard_bytes, query_block):
    docs, items = corpus
    index = build_index(written([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, score int, term int, shard string", 3), shard_bytes=shard_bytes)
    for k in (50, 3):
        found = ranked_search(index, written([(*i, 1, 2) for i in items], "item_id long, text string, query int, terms int"), k, query_block=query_block)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and rows_of(found) == expected(docs, items, k)


def test_query(spark, corpus, tmp_path):
    docs, items = corpus
    path = f"file://{tmp_path}/sf"
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert rows_of(queries.op13_ranked_search(spark, path)) == expected(docs, items)


def test_empty_tables(written):
    docs, items = written([], "doc_id long, text string", 1), written([(1, "a b")], "item_id long, text string", 1)
    assert ranked_search(build_index(docs), items).count() == 0
    full = build_index(written([(1, "a b"), (2, None)], "doc_id long, text string", 1))
    assert ranked_search(full, written([], "item_id long, text string", 1)).count() == 0
    assert rows_of(ranked_search(full, items)) == expected([(1, "a b"), (2, None)], [(1, "a b")])


def test_blocks_below_the_threshold_stay_packed():
    """A term whose best documents come first: later blocks are passed without being unpacked, and lists give their postings."""
    n = 20_000
    lengths = np.full(n, 10)
    lengths[:100] = 4  # shorter documents score more
    hashes = np.concatenate([np.r_[np.uint64(7), np.arange(x - 1, dtype=np.uint64) + np.uint64(100)] for x in lengths])
    x = inverted(hashes, lengths, n, int(lengths.sum()))
    table = pa.Table.from_batches([_lists(x, 0, len(x["term"]), 0)])
    shard = Shard(table.append_column("weight", pa.array([5] * table.num_rows)), np.arange(n), lengths, n, int(lengths.sum()))
    ids, scores = shard.best([7], 50)
    assert ids.tolist() == list(range(50)) and len(set(scores.tolist())) == 1
    row = shard.row_of[7]
    assert shard.unpacked[shard.first[row] : shard.first[row + 1]].sum() <= 16 < 157 == shard.first[row + 1] - shard.first[row]
    shard.unpack(np.arange(len(shard.size)))
    found = defaultdict(list)
    for term, r in shard.row_of.items():
        a, z = shard.at[shard.first[r]], shard.at[shard.first[r + 1] - 1] + shard.size[shard.first[r + 1] - 1]
        found[term] = shard.doc[a:z].tolist()
        assert (shard.impact[a:z] == impacts(np.ones(z - a), lengths[shard.doc[a:z]], n, int(lengths.sum()))).all()
    assert found[7] == list(range(n)) and found[108] == list(range(100, n))
