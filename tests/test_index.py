import json
import math

import pytest
from helpers import tuples
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumdex.functions.codec import vb_hex, vb_numbers, vb_size
from vellumdex.functions.text import query_words
from vellumdex.operators import blocks, index, search, snippets
from vellumdex.operators.prefix import running_total
from vellumdex.sources.corpus import byte_prefix, from_pages, from_table, read_trec, regions_at, write_trec

REGIONS = [
    ("http://a.example/0", "Hello, world! hello"),
    ("http://b.example/1", "World news: the world turns."),
    ("ftp://c.example/2", "hello rejected"),
    ("http://d.example/2", "Abcdefghijklmnop abcdefghijklmno x9 café bar"),
    ("http://e.example/3", "hello there, big WORLD!"),
]
TREC = "".join(f"<DOC>\n<DOCNO>D{k}</DOCNO>\n<TEXT>\n{u}\n{b}\n</TEXT>\n</DOC>\n" for k, (u, b) in enumerate(REGIONS))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("corpus")


@pytest.fixture(scope="module")
def micro(spark, folder):
    (folder / "micro.trec").write_bytes(TREC.encode())
    return read_trec(spark, str(folder / "micro.trec"))


@pytest.fixture(scope="module")
def micro_index(micro, folder):
    return index.SearchIndex.build(micro, f"{folder}/index")


def ranked(df):
    return [(r["doc_id"], round(r["bm25"], 6)) for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_trec_ids_sizes_and_offsets(micro):
    rows = sorted(tuple(r) for r in micro.select("doc_id", "url", "body", "doc_size", "offset").collect())
    assert [(d, u, s) for d, u, _, s, _ in rows] == [(0, REGIONS[0][0], 38), (1, REGIONS[1][0], 47), (2, REGIONS[3][0], 64), (3, REGIONS[4][0], 42)]
    raw = TREC.encode()
    for _, url, body, size, offset in rows:
        assert raw[offset : offset + size].decode() == f"{url}\n{body}"


@pytest.mark.parametrize("tail", ["", "</DOC>", "x", "<TEXT>\nhttp://open.example/\nnot closed\n"])
def test_trec_last_region(spark, folder, tail):
    (folder / f"t{len(tail)}.trec").write_text("<TEXT>\nhttp://u/1\none\n</TEXT>\n<TEXT>\nhttp://u/2\ntwo\n</TEXT>" + tail)
    assert tuples(read_trec(spark, str(folder / f"t{len(tail)}.trec")).select("doc_id", "body")) == [(0, "one"), (1, "two")]


def test_trec_many_files_and_splits(spark, folder):
    many = folder / "many"
    many.mkdir()
    for f in range(3):
        (many / f"{f}.trec").write_text("".join(f"<TEXT>\nhttp://u/{f}/{k}\n{'w' * (k % 50)} {k}\n</TEXT>\n" for k in range(400)))
    (many / "3.trec").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = tuples(read_trec(spark, str(many)).select("doc_id", "url"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == [(k, f"http://u/{k // 400}/{k % 400}") for k in range(1200)]


def test_trec_prefix_and_long_address(spark, folder):
    (folder / "p.trec").write_text("".join(f"<TEXT>\nhttp://u/{k}\nx\n</TEXT>\n" for k in range(100)) + f"<TEXT>\nh{'y' * 1200}\nz\n</TEXT>\n")
    whole = read_trec(spark, str(folder / "p.trec"))
    size = (folder / "p.trec").stat().st_size
    part = read_trec(spark, str(folder / "p.trec"), 3)
    assert part.count() == sum(r["offset"] < size // 10 * 3 for r in whole.collect())
    assert whole.where("doc_id = 100").first()["url"] == "h"
    with pytest.raises(ValueError):
        read_trec(spark, "x", 11)


def test_regions_are_read_from_where_the_documents_table_says(spark, folder, micro, micro_index):
    bodies = {d: b for d, b in tuples(micro.select("doc_id", "body"))}
    assert dict(tuples(regions_at(micro_index.docs.drop("url")))) == bodies
    found = search.search(micro_index, "hello news", search.ANY)
    assert {d: b for _, d, b in tuples(search.fetch_regions(micro_index, found))} == {k: bodies[k] for k in (0, 1, 3)}
    assert tuples(search.fetch_regions(micro_index, search.search(micro_index, "news", 1), 5)) == [(1, 1, "World")]
    moved = folder / "a folder" / "100%.trec"
    moved.parent.mkdir()
    moved.write_bytes(TREC.encode())
    assert tuples(search.fetch_regions(micro_index, search.search(micro_index, "bar", 1), file=str(moved))) == [(1, 2, bodies[2])]
    elsewhere = index.SearchIndex.build(read_trec(spark, str(moved.parent)), f"{folder}/elsewhere")
    assert tuples(search.fetch_regions(elsewhere, search.search(elsewhere, "bar", 1))) == [(1, 2, bodies[2])]
    plan = search.fetch_regions(micro_index, found)._jdf.queryExecution().toString()
    assert "Scan text" not in plan and "In(doc_id" in plan
    nowhere = index.SearchIndex.build(from_table(micro.withColumnRenamed("body", "text").drop("file", "offset")), f"{folder}/nowhere")
    assert search.fetch_regions(nowhere, search.search(nowhere, "news", 1)).count() == 0


def test_written_files_are_read_again(spark, folder):
    rows = [(2, "http://b/", "two\n"), (1, "http://a/", None), (3, None, "three"), (4, "http://d/", "ends </TEXT> early"), (5, "http://é/", "<TEXT>\nhttp://inner/\nx")]
    write_trec(spark.createDataFrame(rows, "doc_id bigint, url string, text string"), f"{folder}/made")
    got = tuples(read_trec(spark, f"{folder}/made").select("doc_id", "url", "body"))
    assert got == [(0, "http://a/", ""), (1, "http://b/", "two\n"), (2, "http://d/", "ends"), (3, "http://é/", "<TEXT>\nhttp://inner/\nx")]


def test_places_go_on_over_batches(spark, folder):
    (folder / "long.trec").write_text("".join(f"<TEXT>\nhttp://u/{k}\n{'é' * (k % 9)}\n</TEXT>\n" for k in range(3000)))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = read_trec(spark, str(folder / "long.trec"))
        raw = (folder / "long.trec").read_bytes()
        for r in got.collect():
            assert raw[r["offset"] : r["offset"] + r["doc_size"]].decode() == f"http://u/{r['doc_id']}\n{'é' * (r['doc_id'] % 9)}"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got.count() == 3000


def test_micro_postings(micro_index):
    want = "abcdefghijklmno 2 1|bar 2 1|big 3 1|caf 2 1|hello 0 2|hello 3 1|news 1 1|the 1 1|there 3 1|turns 1 1|world 0 1|world 1 2|world 3 1|x9 2 1"
    assert [" ".join(map(str, r)) for r in sorted(tuples(micro_index.postings.select("term", "doc_id", "freq")))] == want.split("|")
    assert micro_index.n_docs == 4 and round(micro_index.avg_doc_size, 6) == 63.666667
    assert tuple(index.summary(micro_index).first()) == (4, 11, 14, 16)


@pytest.mark.parametrize(
    "text, mode, want",
    [
        ("hello", 0, [(0, 0.0), (3, 0.0)]),
        ("hello hello", 1, [(0, 0.0), (3, 0.0)]),
        ("hello world", 0, [(3, -1.420098), (0, -1.463805)]),
        ("HELLO, world!", 1, [(3, -1.420098), (0, -1.463805), (1, -1.814374)]),
        ("news zzz", 0, [(1, 1.369001)]),
        ("news zzz", 1, [(1, 1.369001)]),
        ("bar turns", 0, []),
        ("bar turns", 1, [(1, 1.369001), (2, 1.219780)]),
        ("zzz", 0, []),
        ("zzz", 1, []),
        ("", 1, []),
        ("abcdefghijklmnop", 1, []),
    ],
)
def test_micro_queries(micro_index, text, mode, want):
    assert ranked(search.search(micro_index, text, mode)) == want


def test_more_results_than_literals(micro_index, monkeypatch):
    few = ranked(search.search(micro_index, "hello world", 1))
    monkeypatch.setattr(search, "FEW", 1)
    assert ranked(search.search(micro_index, "hello world", 1)) == few


def test_limits_and_modes_are_checked(micro_index):
    for call in (lambda: search.search(micro_index, "hello", 0, 0), lambda: search.search(micro_index, "hello", 2)):
        with pytest.raises(ValueError):
            call()


def test_observed_profiles(micro, micro_index):
    tail = {(r["term"], r["doc_id"]): r["freq"] for r in index.postings_of(micro, keep_tail=False).collect()}
    assert tail["hello", 0] == 1 and ("bar", 2) not in tail
    assert ranked(search.search(micro_index, "abcdefghijklmnXX", 1, key_length=14)) == ranked(search.search(micro_index, "abcdefghijklmno", 1))
    assert "x9" not in {r["term"] for r in index.without_last_term(micro_index.postings).collect()}


def test_batch_equals_single_queries(spark, micro_index):
    texts = ["hello world", "news zzz", "bar turns", "zzz", None, "world world hello"]
    for mode in (0, 1):
        many = search.search_many(micro_index, spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), mode, 3)
        got = {}
        for r in many.collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["bm25"]))
        for k, t in enumerate(texts):
            single = sorted((r["rank"], r["doc_id"], r["bm25"]) for r in search.search(micro_index, t or "", mode, 3).collect())
            assert sorted(got.get(k, [])) == single


def test_batches_of_many_words_are_joined_as_tables(spark, micro_index, monkeypatch):
    queries = spark.createDataFrame([(1, "hello world"), (1, "zzz news"), (2, "world"), (None, "bar")], "query_id int, text string")
    for mode in (0, 1):
        few = tuples(search.search_many(micro_index, queries, mode))
        monkeypatch.setattr(search, "FEW_WORDS", 1)
        assert tuples(search.search_many(micro_index, queries, mode)) == few and few
        monkeypatch.undo()
    assert search.search_many(micro_index, queries.limit(0)).count() == 0 == search.search_many(micro_index, queries.where("false")).count()


def test_batch_reads_its_terms_only_whatever_the_size_of_the_lexicon(spark, micro_index):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
        plan = search.search_many(micro_index, spark.createDataFrame([(1, "hello world zzz")], "query_id int, text string"))._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "In(term, [hello,world])" in plan and "hashpartitioning(term" not in plan and "BroadcastHashJoin" in plan


def test_words_are_looked_up_once(micro_index, monkeypatch):
    micro_index.remembered.clear()
    assert micro_index.frequencies(["hello", "zzz", "hello"]) == {"hello": 2} and micro_index.remembered == {"hello": 2, "zzz": None}
    monkeypatch.setattr(index, "REMEMBERED", 2)
    assert micro_index.frequencies(["zzz", "world"]) == {"world": 3} and set(micro_index.remembered) == {"zzz", "world"}


def test_table_corpus_edge_cases(spark, folder):
    long = "word " * 50_000 + "end"
    rows = [(0, None, "x"), (1, "", "x"), (2, "same same", "x"), (3, "same same", "x"), (4, long, "x"), (5, "éé ßß 𝒳", "x")]
    corpus = from_table(spark.createDataFrame(rows, "doc_id bigint, text string, body string"))
    built = index.SearchIndex.build(corpus, f"{folder}/edge")
    assert {r["doc_id"] for r in built.docs.collect()} == {1, 2, 3, 4, 5}
    assert tuples(built.postings.where("term = 'word'").select("doc_id", "freq")) == [(4, 50_000)]
    assert [r["doc_id"] for r in search.search(built, "same", 1).orderBy("rank").collect()] == [2, 3]
    empty = index.SearchIndex.build(corpus.limit(0), f"{folder}/empty")
    assert empty.n_docs == 0 and math.isnan(empty.avg_doc_size) and search.search(empty, "same", 1).count() == 0
    one = index.SearchIndex.build(corpus.where("doc_id = 2"), f"{folder}/one")
    assert one.avg_doc_size == math.inf and search.search(one, "same", 1).count() == 1


def test_pages_gate_and_size(spark):
    rows = [(0, "http://x/", "a b"), (1, "ftp://x", "a"), (2, None, "a"), (3, "h" * 1000, None)]
    got = tuples(from_pages(spark.createDataFrame(rows, "doc_id bigint, url string, text string")))
    assert got == [(0, "http://x/", "a b", 13), (3, "h", "", 1001)]


def test_and_is_part_of_or(micro_index):
    for text in ("hello world", "the world", "bar x9"):
        both = {r["doc_id"] for r in search.matches(micro_index, text, search.ALL).collect()}
        assert both <= {r["doc_id"] for r in search.matches(micro_index, text, search.ANY).collect()}


def test_terms_are_what_the_tokenizer_allows(micro_index):
    assert all(t.isascii() and t.isalnum() and t == t.lower() and 1 <= len(t) <= 15 for (t,) in tuples(micro_index.lexicon.select("term")))


def test_other_views(micro, micro_index):
    assert tuples(search.next_documents(micro_index, ["hello", "news"], 2)) == [("hello", 3), ("news", 4)]
    assert [r["term"] for r in search.ordered_lists(micro_index, ["world", "hello", "x9"]).orderBy("place").collect()] == ["x9", "hello", "world"]
    assert tuples(search.posting_dump(micro_index, "hello")) == [(0, 2, REGIONS[0][0]), (3, 1, REGIONS[4][0])]
    assert tuples(index.term_ids(micro))[0] == ("abcdefghijklmno", 5)
    lists = {(r["term"], r["slice"]): [tuple(x) for x in r["list"]] for r in index.posting_lists(micro_index.postings, 2).collect()}
    assert lists["world", 0] == [(0, 1), (1, 2)] and lists["world", 1] == [(3, 1)]
    assert tuples(search.fetch(search.search(micro_index, "news", 1), micro, 5)) == [(1, 1, "World")]
    halves = [index.postings_of(micro.where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    assert tuples(index.merge_postings(*halves)) == tuples(index.postings_of(micro))


@pytest.mark.parametrize("n, digits", [(0, "80"), (1, "81"), (127, "FF"), (128, "0081"), (300, "2C82"), (16384, "000081")])
def test_variable_bytes(spark, n, digits):
    row = spark.range(1).select(vb_hex(F.lit(n)).alias("h"), vb_size(F.lit(n)).alias("s"), vb_numbers(F.lit(digits)).alias("n")).first()
    assert (row["h"], row["s"], row["n"]) == (digits, len(digits) // 2, [n])


def test_variable_bytes_round_trip(spark):
    numbers = [0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1, 2**40]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(numbers)], "k int, n bigint").select("k", vb_hex(F.col("n")).alias("h"))
    joined = df.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "").alias("h"))
    assert joined.select(vb_numbers(F.col("h")).alias("n")).first()["n"] == numbers


def test_blocks_over_slices(spark):
    docs = [3, 70_000, 70_001, 200_000, *range(200_100, 200_600, 2)]
    df = spark.createDataFrame([("t", d, 1) for d in docs] + [("u", 0, 300)], "term string, doc_id bigint, freq bigint")
    gaps = sorted((r["place"], r["gap"]) for r in blocks.posting_gaps(df).where("term = 't'").collect())
    assert [g for _, g in gaps] == [b - a for a, b in zip([0, *docs], docs, strict=False)] and [p for p, _ in gaps] == list(range(len(docs)))
    rows = {(r["term"], r["block_no"]): r for r in blocks.posting_blocks(df).collect()}
    assert rows["t", 0]["n"] == 128 and rows["t", 1]["last_doc"] == docs[253] and rows["u", 0]["block_bytes"] == 3
    offsets = sorted(tuple(r) for r in blocks.list_offsets(blocks.posting_blocks(df)).select("list_offset", "term", "list_bytes").collect())
    assert offsets[0][0] == 0 and offsets[1][0] == offsets[0][2]


def test_snippets(spark):
    body = "x " * 256 + "Needle " + "y " * 252 + "needle NEEDLE " + "z " * 600
    corpus = from_table(spark.createDataFrame([(1, body), (2, "needle"), (3, "q " * 600)], "doc_id bigint, text string"))
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "rank int, doc_id bigint")
    best = {r["doc_id"]: r for r in snippets.snippets(ranks, corpus, "needle").collect()}
    assert best[1]["start"] == 512 and best[1]["snippet"].startswith("needle y ") and len(best[1]["snippet"]) == 511
    assert best[2]["snippet"] is None and best[3]["snippet"] is None
    last = {r["doc_id"]: r["start"] for r in snippets.snippets(ranks, corpus, "needle", last_positive=True).collect()}
    assert last[1] >= best[1]["start"]
    assert [r["start"] for r in snippets.windows(corpus, "needle").where("doc_id = 1").orderBy("start").collect()] == list(range(0, len(body) - 512, 512))


def test_windows_of_very_long_and_odd_bodies(spark):
    body = "é𝒳\n " * 1_000_000 + " needle " + "x" * 600
    corpus = from_table(spark.createDataFrame([(1, body), (2, "y" * 512), (3, "y" * 513), (4, "")], "doc_id bigint, text string"))
    found = {(r["doc_id"], r["start"]): r["window"] for r in snippets.windows(corpus, "needle").where("score > 0 OR doc_id > 1").collect()}
    start = 4_000_000 // 512 * 512
    assert found == {(1, start): body[start : start + 512], (3, 0): "y" * 512}


def test_snippets_from_files_equal_those_of_a_table(spark, folder):
    long = "".join(f"<TEXT>\nhttp://u/{k}\n{'some words and ' * (60 * k)} needle {'more words ' * 90}\n</TEXT>\n" for k in range(4))
    (folder / "s.trec").write_text(long)
    corpus = read_trec(spark, str(folder / "s.trec"))
    built = index.SearchIndex.build(corpus, f"{folder}/s")
    top = search.search(built, "needle words", 1)
    assert tuples(snippets.region_snippets(built, top, "needle")) == tuples(snippets.snippets(top, corpus, "needle"))
    assert {r["start"] for r in snippets.region_snippets(built, top, "needle", characters=100).collect()} == {None}


def test_running_total(spark):
    df = spark.createDataFrame([(k, k % 7) for k in range(500)], "k bigint, v bigint").repartition(9)
    total = 0
    for k, v, before in sorted(tuple(r) for r in running_total(df, ["k"], F.col("v"), "before").collect()):
        assert before == total, k
        total += v
    assert running_total(df.limit(0), ["k"], F.col("v"), "before").count() == 0


def test_byte_prefix(spark):
    df = spark.createDataFrame([(k, 10) for k in range(100)], "doc_id bigint, doc_size bigint")
    assert sorted(r["doc_id"] for r in byte_prefix(df, 3).collect()) == list(range(30))
    assert byte_prefix(df, 10).count() == 100


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_query_words_by_pattern(text):
    import re

    assert query_words(text) == [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]


def test_query_reads_its_terms_only(micro_index):
    plan = search.scored_postings(micro_index, {"hello": (2, 1), "world": (3, 1)})._jdf.queryExecution().toString()
    assert "In(term, [hello,world])" in plan.replace("`", "") and "map(" not in plan and "ReadSchema: struct<term:string,doc_id:bigint,freq:bigint,doc_size:bigint>" in plan and "Join" not in plan


def test_stream_append(spark, folder):
    from vellumdex.streaming.append import append_batch, append_stream, compact, grown_index

    source, out = folder / "stream", f"{folder}/grown"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"doc_id": 10 * k + j, "text": f"word{j} common"}) for j in range(4)))
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).json(str(source))
    append_stream(stream, out, f"{folder}/progress").awaitTermination()
    every = spark.read.schema("doc_id bigint, text string").json(str(source))
    again = [r["doc_id"] for r in spark.read.parquet(f"{out}/docs/batch=2").collect()]
    append_batch(every.where(F.col("doc_id").isin(again)), out, 2)
    grown = grown_index(spark, out)
    whole = index.postings_of(from_table(every))
    assert grown.n_docs == 12 and tuples(grown.postings.select("term", "doc_id", "freq")) == tuples(whole)
    assert search.search(grown, "common word1", search.ALL).count() == 3
    merged = compact(spark, out, f"{folder}/merged")
    for name in ("docs", "postings", "lexicon"):
        assert tuples(getattr(merged, name)) == tuples(getattr(grown, name))
    assert (merged.n_docs, merged.avg_doc_size) == (grown.n_docs, grown.avg_doc_size)
    append_batch(spark.createDataFrame([(100, "common late")], "doc_id bigint, text string"), f"{folder}/merged", 3)
    later = grown_index(spark, f"{folder}/merged")
    assert later.n_docs == 13 and later.frequencies(["common", "late", "word1"]) == {"common": 13, "late": 1, "word1": 3}


def test_command_line(spark, folder, micro):
    from vellumdex.cli import main

    said = []
    main(["build", str(folder / "micro.trec"), f"{folder}/cli"], out=said.append)
    main(["query", f"{folder}/cli", "--mode", "1", "--corpus", str(folder / "micro.trec")], iter(["hello world\n", "zzz\n", "\n", "news\n"]), said.append)
    again = []
    main(["query", f"{folder}/cli", "--mode", "1", "--corpus"], iter(["hello world\n", "zzz\n"]), again.append)
    assert again == said[1:]
    assert said[0] == "4 documents, 11 terms" and said.count("Showing Top 10") == 2 and "No result found." in said
    assert said[2].startswith("[1]\thttp://e.example/3\nBM25: \t-1.420098\n<Snippet>")
