"""Queries over tagged text files, and their SQL.

The files are written from `documents`, in order of doc_id; texts that have tags in them cut regions elsewhere, as in
any such file. SQL has the files as one text; a place in it is the place in a file plus the sizes of earlier files.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumdex import cli
from vellumdex.operators import search, snippets
from vellumdex.plans.index_queries import BASE, QUERY, URL, _first, _windows, built
from vellumdex.session import new_path, removed_at_exit
from vellumdex.sources.corpus import read_trec, write_trec
from vellumdex.sources.tables import table

_WRITTEN: dict[tuple[str, str], str] = {}
_SAID: dict[tuple[str, str], tuple[str, list[str]]] = {}


def trec_files(spark, sf):
    """Folder of tagged files made of a folder's documents, written once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        path = new_path(spark, "trec")
        write_trec(table(spark, sf, "documents"), path)
        removed_at_exit(spark, path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def trec_index(spark, sf):
    return built(spark, sf, "trec", lambda spark, sf: read_trec(spark, trec_files(spark, sf)))


def trec_documents(spark, sf):
    """The documents table; a document's place is that in all files laid one after another."""
    files = spark.read.text(trec_files(spark, sf)).select("_metadata.file_path", "_metadata.file_size").distinct()
    before = F.coalesce(F.sum("file_size").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select(F.col("file_path").alias("file"), before.alias("start"))  # one row a file
    return trec_index(spark, sf).docs.join(starts, "file").select("doc_id", "url", "doc_size", (F.col("start") + F.col("offset")).alias("place"))


def _top(spark, sf):
    return search.rank(trec_index(spark, sf), QUERY, search.ANY, 10)


def trec_or_top10(spark, sf):
    return search.search(trec_index(spark, sf), QUERY, search.ANY, 10)


def trec_result_lines(spark, sf):
    found = search.search(trec_index(spark, sf), QUERY, search.ANY, 10)
    return found.select("rank", search.rendered(found).alias("line"))


def trec_fetch(spark, sf):
    return search.fetch_regions(trec_index(spark, sf), _top(spark, sf))


def trec_snippets(spark, sf):
    return snippets.region_snippets(trec_index(spark, sf), _top(spark, sf), QUERY)


def trec_command_line(spark, sf):
    """What the command line says when it builds an index, once a session, and answers a query with snippets."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SAID:
        folder, said = new_path(spark, "index-cli"), []
        cli.main(["build", trec_files(spark, sf), folder], out=said.append)
        removed_at_exit(spark, folder)
        _SAID[key] = folder, said
    folder, said = _SAID[key]
    answer: list[str] = []
    cli.main(["query", folder, "--mode", str(search.ANY), "--corpus"], [QUERY, "", "not read"], answer.append)
    return spark.createDataFrame(list(enumerate([*said, *answer])), "place int, line string")


QUERIES = {f.__name__: f for f in (trec_documents, trec_or_top10, trec_result_lines, trec_fetch, trec_snippets, trec_command_line)}

TEXTS = """WITH filed AS (SELECT string_agg('<DOC>\n<DOCNO>D' || doc_id || '</DOCNO>\n<TEXT>\n' || coalesce(url, '') || '\n' || coalesce(text, '') || '\n</TEXT>\n</DOC>\n', ''
    ORDER BY doc_id) AS raw FROM documents),
  cut AS (SELECT string_split(raw, '</TEXT>') AS ps FROM filed),
  pieces AS (SELECT unnest(ps) AS piece, generate_subscripts(ps, 1) AS k, len(ps) AS n FROM cut),
  placed AS (SELECT *, sum(strlen(piece) + 7) OVER (ORDER BY k) - strlen(piece) - 7 AS base,
    CASE WHEN instr(piece, '<TEXT>\n') > 0 THEN substring(piece, instr(piece, '<TEXT>\n') + 7) END AS region FROM pieces),
  texts AS (SELECT row_number() OVER (ORDER BY k) - 1 AS doc_id, split_part(region, '\n', 1) AS url, substring(region, instr(region, '\n') + 1, greatest(0, length(region) - instr(region, '\n') - 1)) AS text,
    strlen(region) - 1 AS size, CAST(base + strlen(piece) - strlen(region) AS BIGINT) AS place FROM placed WHERE k < n AND region LIKE 'h%'),"""
TREC = BASE.replace("WITH texts AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),", TEXTS).replace("strlen(text) AS doc_size", "size AS doc_size")
TOP = _first(QUERY).replace(BASE, TREC)

BEST = f"""{TOP}, {_windows(QUERY).replace("cut AS", "cut_up AS").replace("FROM cut)", "FROM cut_up)")}, best AS (
    SELECT doc_id, start, translate(substring(win, 1, 511), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS snippet FROM windows WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) = 1)"""
LINE = "printf('[%d]%s%s%sBM25: %s%.6f', rank, chr(9), url, chr(10), chr(9), bm25)"

SQL = {
    "trec_documents": f"{TREC} SELECT doc_id, {URL}, size AS doc_size, place FROM texts",
    "trec_or_top10": f"{TOP} SELECT rank, doc_id, {URL}, bm25 FROM ranked JOIN texts USING (doc_id)",
    "trec_result_lines": f"{TOP} SELECT rank, {LINE} AS line FROM ranked JOIN texts USING (doc_id)",
    "trec_fetch": f"{TOP} SELECT rank, doc_id, text AS body FROM ranked JOIN texts USING (doc_id)",
    "trec_snippets": f"{BEST} SELECT rank, doc_id, start, snippet FROM ranked LEFT JOIN best USING (doc_id)",
    "trec_command_line": f"""{BEST} SELECT 0 AS place, (SELECT count(*) FROM docs) || ' documents, ' || (SELECT count(*) FROM lex) || ' terms' AS line
      UNION ALL SELECT 1, 'Showing Top 10'
      UNION ALL SELECT 1 + rank, {LINE} || chr(10) || '<Snippet>' || chr(10) || coalesce(snippet, '') || chr(10) || '</Snippet>'
        FROM ranked JOIN texts USING (doc_id) LEFT JOIN best USING (doc_id)""",
}
