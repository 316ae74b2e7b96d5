import math
import random

import numpy as np


def test_url_filters(written):
    from faultline.llm.queries import HOST_RULES
    from faultline.llm.url_filters import PATTERN_RULES, UrlRule, host_rule, url_filters

    urls = [
        None, "", "no scheme", "http://Example.COM/en/x", "http://www.example.com/en/x", "http://www.example.com/EN/x", "https://blog.example.com/en/?q#f", "http://badexample.com/en/",
        "http://example.com", "http://example.com?x=/en/", "ftp://a.net/es/1", "ftp://a.net/esx", "x://net/fr/", "http://a.net/fr/b?c", "http://org.example/://y", "http://poker.example.org/a", "http://pokerface.org/", "http://x.org/login", "http://é.com/ü",
    ]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls)] + [(3, urls[3], "h", "p"), (None, urls[4], "h", "p")]
    rules = [host_rule(v, r) for v, r in HOST_RULES] + list(PATTERN_RULES)
    out = url_filters(written(rows, "page_id long, url string, host string, path string"), rules).collect()
    assert len(out) == len(rows)

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u[u.index("://") + 3 :]
        n = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        tail = rest[n:]
        m = next((k for k, c in enumerate(tail) if c in "?#"), len(tail))
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), tail[:m]

    for r in out:
        host, path = parts(r.url)
        assert (r.host, r.path) == (host, path)
        fits = [(len(x), x, v) for v, x in HOST_RULES for h, _, p in [x.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert r.rule == (max(fits)[1] if fits else None)
        if fits:
            assert r.verdict == max(fits)[2]
    verdict = {r.page_id: r.verdict for r in out if r.page_id is not None}
    assert verdict[15] == "block" and verdict[16] == "allow" and verdict[17] == "block" and verdict[18] == "allow" and verdict[0] == "allow"
    assert url_filters(written([], "page_id long, url string", 1), rules).count() == 0
    # a rule without a literal is tried on every url
    any_rule = [UrlRule("digits", "block", "[0-9]{3}")]
    assert [r.verdict for r in url_filters(written([(1, "http://a.b/12"), (2, "http://a.b/123")], "page_id long, url string"), any_rule).orderBy("page_id").collect()] == ["allow", "block"]


def test_host_rules_leave_queries_and_fragments_alone(written):
    from faultline.llm.queries import HOST_RULES
    from faultline.llm.url_filters import host_rule, url_filters

    urls = ["http://blog.org?ref=www.example.com/en/a", "http://blog.org?u=x.example.com/en/", "http://blog.org#x.example.com/en/", "http://blog.org?a.com/", "http://blog.org#a.net/es/", "http://blog.org?a.net/fr/", "http://x.example.com/en/?a.net/fr/"]
    out = url_filters(written(list(enumerate(urls)), "page_id long, url string"), [host_rule(v, r) for v, r in HOST_RULES]).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in out} == {**{i: (None, "allow") for i in range(6)}, 6: ("example.com/en/", "block")}


def test_host_rules_with_capitals_and_many_rules(written):
    from faultline.llm.url_filters import UrlRule, host_rule, url_filters

    urls = ["http://example.org/Docs/a", "http://example.org/docs/a", "http://Example.ORG/Docs/", "http://a.example.org/x"]
    rules = [host_rule("block", "Example.org/Docs/")] + [UrlRule(f"w{i}", "block", f"tok{i}x", (f"tok{i}x",)) for i in range(700)] + [host_rule("allow", "h.com/a/"), host_rule("block", "h.com/b/")]
    more = ["http://h.com/a/tok5x", "http://h.com/b/", "http://q.com/tok699x"]
    out = url_filters(written(list(enumerate(urls + more)), "page_id long, url string"), rules).collect()
    assert [r.verdict for r in sorted(out, key=lambda r: r.page_id)] == ["block", "allow", "block", "allow", "allow", "block", "block"]


def test_lattice_points_are_nearest():
    from faultline.llm.embedding_dedup import ROOTS, nearest

    assert len(np.unique(ROOTS, axis=0)) == 240 and np.allclose((ROOTS**2).sum(1), 2)
    y = np.random.default_rng(0).normal(size=(2000, 8)) * 3
    p = nearest(y)
    best = ((y - p) ** 2).sum(1)
    twice = np.rint(2 * p).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(1) & (twice.sum(1) % 4 == 0)).all()
    for r in ROOTS:
        assert (best <= ((y - p - r) ** 2).sum(1) + 1e-9).all()


def test_embedding_dedup(written):
    from faultline.llm.embedding_dedup import embedding_dedup

    rng = np.random.default_rng(2)

    def unit(x):
        return x / np.linalg.norm(x)

    rows = [(i, unit(rng.normal(size=64)).tolist()) for i in range(150)]
    for k in range(200):
        v = np.array(rows[k % 12][1])
        w = rng.normal(size=64)
        w = unit(w - (w @ v) * v)
        c = 0.9 + 0.1 * rng.random()
        rows.append((1000 + k, (c * v + math.sqrt(1 - c * c) * w).tolist()))
    rows += [(2000 + k, rows[0][1]) for k in range(30)] + [(3000, [2 * x for x in rows[1][1]]), (1, rows[1][1])]
    odd = [(4000, None), (4001, []), (4002, [0.0] * 64), (4003, [1.0, None] + [0.0] * 62), (4004, [math.nan] + [1.0] * 63), (4005, [math.inf] + [1.0] * 63), (4006, [1.0, 0.0]), (4007, [2.0, 0.1]), (None, rows[3][1])]
    df = written([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, rep int, key int")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup(df).collect()]
    assert len(got) == len(rows) + len(odd)
    names = [-1 if i is None else i for i, _ in rows + [odd[-1]]]
    e = np.array([v for _, v in rows + [odd[-1]]])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    link = e @ e.T >= 0.9
    np.fill_diagonal(link, False)
    want = int(link.sum())
    odd_ids = {4000, 4001, 4002, 4003, 4004, 4005}
    found = sum(n for i, n, *_ in got if i not in {*odd_ids, 4006, 4007})
    assert 0.98 * want <= found <= want
    for i, n, c, kept in got:
        if i in odd_ids:
            assert (n, c, kept) == (0, i, True)
        if i in (4006, 4007):
            assert (n, c, kept) == (1, 4006, i == 4006)
    # all copies of a vector have the same links, none of them lost
    zero = [n for i, n, *_ in got if i == 0 or i is not None and 2000 <= i < 2030]
    assert len(zero) == 31 and len(set(zero)) == 1 and zero[0] >= 30
    assert all(c is None for i, _, c, _ in got if i in (3, None)) and len(names) == len(e)
    assert embedding_dedup(written([], "vec_id long, embedding array<float>", 1)).count() == 0


def test_components(spark, written):
    from faultline.llm.components import components
    from faultline.llm.storage import Workspace

    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (200, 200)]
    out = {r.id: r.component for r in components(written(chain, "a long, b long"), Workspace(spark, "test")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    from tests.llm.corpus import documents, prose

    path = f"file://{tmp_path}/sf"
    rng = random.Random(9)
    clean = [(1000 + i, "\n".join(prose(rng, 14).capitalize() + "." for _ in range(8)), f"s{i % 3}") for i in range(12)]
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in [(x[0], x[1], x[2]) for x in documents()] + clean]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        if k < 4:
            assert docs.columns == names
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if k == 0:
            assert {i for i, *_ in clean} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
    again = corpus_pipeline.run(spark, path)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in docs.collect())


def test_pipeline_keeps_one_row_of_each_group(spark, written):
    import corpus_pipeline

    from tests.llm.corpus import prose

    rng = random.Random(5)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    rows = [(5, a), (5, a), (7, a + " more"), (None, b), (8, b), (None, b + " more"), (None, c), (9, d), (9, d), (9, e), (4, a + " end"), (None, e)]
    docs = written([(i, t, "en", "s", len(t), f"r{k}") for k, (i, t) in enumerate(rows)], schema)
    stage = dict(corpus_pipeline.STAGES)["ngram_join"]
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert all(rows[int(r.row[1:])] == (r.doc_id, r.text) for r in got)
    group = lambda t: next(k for k, x in enumerate((a, b, c, d, e)) if t.startswith(x))
    # one row a group, of its least id, a null one first
    assert sorted((group(r.text), -1 if r.doc_id is None else r.doc_id) for r in got) == [(0, 4), (1, -1), (2, -1), (3, 9), (4, -1)]
    assert stage(spark, written([], schema, 1), "").count() == 0


def test_pipeline_stages_keep_clashing_columns_and_short_remainders(spark, written):
    """Columns of every name that an operator adds come through, in any case of letters; a document of one paragraph of its own under
    lines that others have stays; null texts and empty tables have a defined result in each stage."""
    import corpus_pipeline

    from tests.llm.corpus import prose

    rng = random.Random(11)
    menu = "\n".join(f"Line {k} of a boilerplate that all of these pages have in common." for k in range(9))
    names = ("quality", "N_Lines", "n_dropped", "row", "copy", "copies", "size", "component_id", "rep", "target", "id", "h1", "spans")
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    texts = [menu + "\n" + " ".join(prose(rng, 14).capitalize() + "." for _ in range(6)) for _ in range(6)] + [None, "", menu, menu + "\n\n"]
    docs = written([(i, t, "s", len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names) and all(r.n_chars == len(r.text or "") for r in rows if name != "ngram_join"), name
        kept = {r.doc_id for r in rows}
        if name == "line_dedup":
            # of the last two nothing but shared lines was there; null and empty texts lose nothing
            assert kept == set(range(8)) and {r.doc_id: r.text for r in rows}[1] == texts[1].split("\n")[-1]
        if name in ("ngram_join", "mixing"):
            assert {6, 7} <= kept
        assert stage(spark, written([], schema, 1), "").count() == 0
    assert {6, 7} <= {r.doc_id for r in corpus_pipeline.pack_sequences(spark, docs, "").collect()}
    assert corpus_pipeline.pack_sequences(spark, written([], schema, 1), "").count() == 0


def test_pipeline_leaves_no_tables_of_its_stages(spark, tmp_path):
    import os

    import corpus_pipeline

    from tests.llm.corpus import prose

    rng = random.Random(13)
    rows = [(i, "\n".join(prose(rng, 14).capitalize() + "." for _ in range(8)), "en", f"s{i % 3}", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    home = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(home))
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/sf").count() >= 30
    left = {f"{w.rsplit('-', 1)[0]}/{t.rsplit('-', 1)[0]}" for w in set(os.listdir(home)) - before for t in os.listdir(f"{home}/{w}")}
    assert {t for t in left if not t.startswith("packing")} <= {"pipeline/mixing"}, left


def test_pipeline_stage_of_near_copies_leaves_its_rows_only(spark, written):
    """Stages that a caller runs one by one keep nothing of the join beside its result."""
    import os

    import corpus_pipeline
    from tests.llm.corpus import prose

    rng = random.Random(14)
    rows = [(i, prose(rng, 60), "en", "s", 1) for i in range(5)]
    home = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(home))
    stage = dict(corpus_pipeline.STAGES)["ngram_join"]
    assert stage(spark, written(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long"), "").count() == 5
    left = {f"{w.rsplit('-', 1)[0]}/{t.rsplit('-', 1)[0]}" for w in set(os.listdir(home)) - before for t in os.listdir(f"{home}/{w}")}
    assert left == {"pipeline-rows/numbered", "pipeline-rows/kept"}, left
