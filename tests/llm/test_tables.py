"""Archives, source mixing, linked components, the pipeline and the registered queries."""

import base64
import hashlib
import math

import pytest

import __spark_entry__ as entry
from tamiz.llm import registered, source_mixing, warc_revisits
from tamiz.llm import common
from tamiz.llm.common import components
from tamiz.session import new_path
from tests.llm.helpers import DATA, HAVE_DATA, classes, documents


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [
    (1, "http://a.example/é", "<p>same</p>"), (2, "http://b.example/ x\r\nWARC-Type: revisit", "<p>same</p>"), (3, None, None), (4, "u", ""),
    (5, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (None, "n", "<p>same</p>"), (6, "u", "😀\x00é" * 1000), (2, "again", "<p>same</p>"), (7, "u", "x"),
]


@pytest.mark.parametrize("min_bytes", [0, 2, 1000])
def test_archives_round_trip(spark, min_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as path")
    got = warc_revisits.warc_revisits(pages, min_bytes=min_bytes).collect()
    want = []
    seen = set()
    for page, _, html in sorted(PAGES, key=lambda p: (p[0] is not None, p[0] or 0), reverse=True):
        size = len((html or "").encode())
        first = size < min_bytes or digest(html) not in seen
        latest = max(p for p, _, h in PAGES if (h or "") == (html or "") and p is not None)
        seen.add(digest(html))
        want.append((page, size, digest(html), "response" if first else "revisit", None if first else latest))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))


def test_headers_are_fresh_and_payloads_whole(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    raw = warc_revisits.write_archive(warc_revisits.response_records(pages, "2020-01-01T00:00:00Z"), new_path(spark, "raw"))
    read = warc_revisits.read_archive(spark, raw, payloads=True)
    assert sorted((str(r.page_id), r.payload) for r in read.collect()) == sorted((str(p), h or "") for p, _, h in PAGES)
    assert all(r.claimed == r.payload_digest for r in read.collect())
    final = warc_revisits.rewrite_deduplicated(spark, raw, new_path(spark, "final"), "2021-05-05T00:00:00Z")
    text = "".join(r.value for r in spark.read.text(final).collect())
    assert "2021-05-05" in text and "2020-01-01" not in text
    empty = warc_revisits.warc_revisits(pages.limit(0))
    assert empty.count() == 0


def test_mix_meets_targets_and_bounds(spark):
    texts, sources = [], []
    for s, (count, length) in {"a": (300, 7), "b": (200, 40), "c": (3, 5), None: (150, 11)}.items():
        for k in range(count):
            texts.append("w " * (length + k % 17))
            sources.append(s)
    texts += ["", None]
    sources += ["a", "c"]
    rows = [(k, t, s) for k, (t, s) in enumerate(zip(texts, sources))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as tilt")
    got = source_mixing.mix_sources(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    size = {s: sum(len((t or "").split()) for t, x in zip(texts, sources) if x == s) for s in ("a", "b", "c", None)}
    targets, left, open_ = {}, sum(size.values()), dict(zip(("a", "b", "c", None), (5, 2, 1, 5)))
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 3 * size[s]]
        if not over:
            targets |= {s: level * w for s, w in open_.items()}
            break
        for s in over:
            targets[s] = 3.0 * size[s]
            left -= targets[s]
            del open_[s]
    for s in size:
        mine = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, targets[s], rel_tol=1e-9) and r.source_size == size[s] for r in mine)
        assert all(r.size == len((texts[r.doc_id] or "").split()) and r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in mine)
        assert abs(sum(r.taken for r in mine) - targets[s]) <= 0.01 * targets[s] + 12
        tilt = {r.size: r.rate for r in mine if r.size and r.rate < 3}
        if len(tilt) > 2:  # log rates lie on a line through 0
            assert len({round(math.log(v) / k, 6) for k, v in tilt.items()}) == 1
    again = source_mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert source_mixing.mix_sources(df.limit(0)).count() == 0
    assert [r.taken for r in source_mixing.mix_sources(df.where("text is null or text = ''")).collect()] == [0, 0]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(200, 300)] + [(7, 8), (8, 7), (9, 9), (8, 7)]
    want = classes(links, {n for link in links for n in link})
    got = components(spark.createDataFrame(links, "a long, b long"), "test")
    assert {r.node: r.root for r in got.collect()} == {n: r for n, r in want.items() if n != 9}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_components_write_no_round_that_changes_nothing(spark, monkeypatch):
    written = []

    def counted(df, name, plain=common.settle):
        written.append(name)
        return plain(df, name)

    monkeypatch.setattr(common, "settle", counted)
    star = spark.createDataFrame([(1, n) for n in range(2, 30)] + [(40, 41)], "a long, b long")
    got = {r.node: r.root for r in components(star, "test").collect()}
    assert got == {n: 1 for n in range(1, 30)} | {40: 40, 41: 40} and written == ["test-links"]
    written.clear()
    chained = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a long, b long")
    assert {r.node: r.root for r in components(chained, "test").collect()} == {n: 1 for n in range(1, 5)}
    assert written[0] == "test-links" and len(written) <= 3


def test_every_operator_and_the_pipeline_are_registered():
    names = registered.queries()
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{k}" for k in range(1, 14))}
    assert set(names) <= set(entry.queries()) and set(registered.oracle_sql()) <= set(names)


@pytest.mark.skipif(not HAVE_DATA, reason="tables not present")
@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registered.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(registered.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(str([dict(zip(names, r))[c] for c in columns]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


@pytest.mark.skipif(not HAVE_DATA, reason="tables not present")
def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from tamiz.llm import disclosure, order_minhash, spaced_seeds
    from tamiz.llm.common import table

    docs = table(spark, DATA, "documents")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    final = pipeline.run(spark, DATA).collect()
    assert final and {r.doc_id for r in final} <= {r.doc_id for r in docs.select("doc_id").collect()}
    results = []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        results.append(docs)
    toxic_left, unique, fresh, clean, mixed = results
    assert unique.columns == fresh.columns == clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert order_minhash.near_duplicates(unique).groupBy("class_id").count().where("count > 1").count() == 0
    assert order_minhash.near_duplicates(toxic_left).select("class_id").distinct().count() == unique.count()
    assert spaced_seeds.contaminated(fresh, table(spark, DATA, "benchmark")).count() == 0
    assert clean.count() == fresh.count() == mixed.count()
    left = disclosure.base_spans(clean).selectExpr("size(_email) + size(_ip) + size(_card) + size(_phone) as n")
    assert left.where("n > 0").count() == 0
    assert sorted(map(str, final)) == sorted(map(str, mixed.collect()))
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id: r.text for r in final} == kept and all(r.taken == r.copies * r.size for r in final)


def test_pipeline_stages_take_odd_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    text = "one plain sentence of many different words that nobody repeats in any other place of the table at all"
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, None, None, None), (None, "", "en", "b", 0), (3, "w " * 20_000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").selectExpr(
        "*", "1 as size", "2 as key", "3 as p_toxic", "'x' as row")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a test item of some twenty words that no document of this small table holds in whole or in part today")],
                          "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            before, table = table, stage(spark, table, str(tmp_path))
            assert name == "mixing" or table.columns == before.columns
            path = str(tmp_path / f"{name}-{before.count()}")
            table.write.parquet(path)
            table = spark.read.parquet(path)
        if before.count():
            # The null and the empty text are equal, so one of them stays: the one with the least doc_id, null first.
            assert sorted((r.doc_id or 0) for r in table.collect()) == [0, 1, 3]
        else:
            assert table.count() == 0
