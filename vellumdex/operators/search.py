"""Ranked keyword queries over an index: all terms or any term, BM25, the first k."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumdex.functions.scoring import number, rarity, rarity_sql, saturation_sql
from vellumdex.functions.text import query_words
from vellumdex.operators.index import SearchIndex
from vellumdex.sources.corpus import regions_at

ALL, ANY = 0, 1
DIGITS = 6
#: Results up to which documents are looked up by literal ids.
FEW = 1000
#: Words of a table of queries, each query's counted, up to which they are literals and broadcast.
FEW_WORDS = 10_000


def known_terms(index: SearchIndex, text: str, key_length: int | None = None) -> dict[str, tuple[int, int]]:
    """df and number of repetitions of each query word that is in the lexicon; others are ignored.

    The filter on literal terms reaches the lexicon's files; what comes back is bounded by the query. With
    `key_length`, words are looked up by so many first characters, and the last term in byte order answers.
    """
    typed = Counter(query_words(text))
    if not typed:
        return {}
    if key_length is None:
        return {w: (n, typed[w]) for w, n in index.frequencies(list(typed)).items()}
    cut = Counter()
    for word, n in typed.items():
        cut[word[:key_length]] += n
    prefix = F.substring("term", 1, key_length)
    rows = index.lexicon.where(prefix.isin(sorted(cut))).groupBy(prefix.alias("prefix")).agg(F.max(F.struct("term", "df")).alias("last")).collect()
    return {r["last"]["term"]: (r["last"]["df"], cut[r["prefix"]]) for r in rows}


def scored_postings(index: SearchIndex, known: dict[str, tuple[int, int]]) -> DataFrame:
    """(doc_id, term, score) of all postings of the known terms; a term typed n times scores n times.

    The terms are literals, so only their row groups are read, and so is all of the score that depends on the
    term; the size of the document lies beside each posting: no join.
    """
    if not known:
        return index.postings.selectExpr("doc_id", "term", "0.0D AS score").limit(0)
    # terms are of letters and digits only
    weights = " ".join(f"WHEN '{t}' THEN {number(n * rarity(df, index.n_docs))}" for t, (df, n) in sorted(known.items()))
    listed = ", ".join(f"'{t}'" for t in sorted(known))
    score = f"(CASE term {weights} END) * {saturation_sql('freq', 'doc_size', index.avg_doc_size)} AS score"
    return index.postings.where(f"term IN ({listed})").selectExpr("doc_id", "term", score)


def matches(index: SearchIndex, text: str, mode: int, key_length: int | None = None) -> DataFrame:
    """(doc_id, bm25): all documents with any (ANY) or with all (ALL) of the known words of a query.

    Words that no document has are ignored in both modes; without a known word nothing matches.
    """
    if mode not in (ALL, ANY):
        raise ValueError("mode must be 0 (all words) or 1 (any word)")
    known = known_terms(index, text, key_length)
    found = scored_postings(index, known).groupBy("doc_id")
    if mode == ANY:
        return found.agg(F.expr("sum(score) AS bm25"))
    return found.agg(F.expr("sum(score) AS bm25"), F.expr("count(1) AS n")).where(f"n = {len(known)}").select("doc_id", "bm25")


def _ranked(df: DataFrame, limit: int) -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    first = df.orderBy(F.desc("bm25"), "doc_id").limit(limit)
    # a window over the `limit` rows that are left
    return first.selectExpr("CAST(row_number() OVER (ORDER BY bm25 DESC, doc_id) AS INT) AS rank", "doc_id", "bm25")


def rank(index: SearchIndex, text: str, mode: int = ALL, limit: int = 10, key_length: int | None = None) -> DataFrame:
    """(rank, doc_id, bm25): the best documents of a query, scores rounded to six digits, ties by doc_id."""
    return _ranked(matches(index, text, mode, key_length).selectExpr("doc_id", f"round(bm25, {DIGITS}) AS bm25"), limit)


def fetched(ranked: DataFrame) -> tuple[DataFrame, list[int] | None]:
    """Some ranked documents as a table of their own, and their ids, if there are up to FEW: the ranking runs here, once.

    Otherwise the ranking itself, to be joined by what Spark finds best, and no ids.
    """
    rows = ranked.limit(FEW + 1).toArrow()
    if rows.num_rows > FEW:
        return ranked, None
    return F.broadcast(ranked.sparkSession.createDataFrame(rows, ranked.schema)), rows["doc_id"].to_pylist()


def of_documents(table: DataFrame, ranked: DataFrame, ids: list[int] | None) -> DataFrame:
    """Rows of a table that has a doc_id, for what `fetched` gave, with the columns of `ranked`.

    The ids are literals that reach the table's files, which then are read only where they may have them.
    """
    return (table if ids is None else table.where(F.col("doc_id").isin(ids))).join(ranked, "doc_id")


def search(index: SearchIndex, text: str, mode: int = ALL, limit: int = 10, key_length: int | None = None) -> DataFrame:
    """(rank, doc_id, url, bm25): `rank` with addresses. Runs the ranking when called."""
    found = fetched(rank(index, text, mode, limit, key_length))
    return of_documents(index.docs.select("doc_id", "url"), *found).select("rank", "doc_id", "url", "bm25")


def _known_words(index: SearchIndex, typed: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """(query_id, term, repeats, df, needed) of the known words, and these words if they are few; needed counts a query's."""
    few = typed.limit(FEW_WORDS + 1).toArrow()
    if few.num_rows > FEW_WORDS:
        known = typed.join(index.lexicon.select("term", "df"), "term")
        return known.withColumn("needed", F.count(F.lit(1)).over(Window.partitionBy("query_id"))), None
    frequencies = index.frequencies(few["term"].to_pylist())
    few = few.filter(pa.array([t in frequencies for t in few["term"].to_pylist()], pa.bool_()))
    needed = Counter(few["query_id"].to_pylist())
    few = few.append_column("df", pa.array([frequencies[t] for t in few["term"].to_pylist()], pa.int64()))
    few = few.append_column("needed", pa.array([needed[q] for q in few["query_id"].to_pylist()], pa.int64()))
    schema = T.StructType([*typed.schema.fields, T.StructField("df", T.LongType()), T.StructField("needed", T.LongType())])
    return F.broadcast(typed.sparkSession.createDataFrame(few, schema)), sorted(frequencies)


def search_many(index: SearchIndex, queries: DataFrame, mode: int = ALL, limit: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, bm25) for a table of (query_id, text) of any length.

    The queries' words, if there are up to FEW_WORDS, are looked up when called; they are literals then, so only
    their row groups are read, and are broadcast to the postings, which stay where they are. More words are joined
    as a table. Ranking keeps `limit` rows a query before its shuffle. A null text, or one without known words,
    matches nothing; rows of the same query_id are one query.
    """
    if limit < 1 or mode not in (ALL, ANY):
        raise ValueError("limit must be 1 or more and mode 0 or 1")
    typed = queries.selectExpr("query_id", "explode(regexp_extract_all(text, '[A-Za-z0-9]+', 0)) AS word")
    typed = typed.groupBy("query_id", F.expr("lower(word) AS term")).agg(F.expr("count(1) AS repeats"))
    known, words = _known_words(index, typed)
    postings = index.postings if words is None else index.postings.where(F.col("term").isin(words))
    score = f"repeats * {rarity_sql('df', index.n_docs)} * {saturation_sql('freq', 'doc_size', index.avg_doc_size)}"
    found = postings.join(known, "term").groupBy("query_id", "doc_id")
    found = found.agg(F.expr(f"round(sum({score}), {DIGITS}) AS bm25"), F.expr("count(1) AS n"), F.expr("max(needed) AS needed"))
    if mode == ALL:
        found = found.where("n = needed")
    place = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS INT) AS rank"
    return found.selectExpr("query_id", place, "doc_id", "bm25").where(f"rank <= {limit}")


def next_documents(index: SearchIndex, terms: list[str], at_least: int) -> DataFrame:
    """(term, doc_id): of each term's list the first document of at least this id, the number of documents at the end."""
    lists = index.postings.where(F.col("term").isin(terms)).groupBy("term")
    first = F.min(F.when(F.col("doc_id") >= at_least, F.col("doc_id")))
    return lists.agg(F.coalesce(first, F.lit(index.n_docs)).cast("bigint").alias("doc_id"))


def ordered_lists(index: SearchIndex, terms: list[str]) -> DataFrame:
    """(place, term, df): a query's lists, shortest first, ties by term."""
    found = index.lexicon.where(F.col("term").isin(terms)).select("term", "df")
    return found.select(F.row_number().over(Window.orderBy("df", "term")).cast("int").alias("place"), "term", "df")


def posting_dump(index: SearchIndex, term: str) -> DataFrame:
    """(doc_id, freq, url): one term's list with addresses."""
    return index.postings.where(F.col("term") == term).join(index.docs, "doc_id").select("doc_id", "freq", "url")


def fetch(ranked: DataFrame, corpus: DataFrame, characters: int | None = None) -> DataFrame:
    """(rank, doc_id, body): texts of some ranked documents from a table, whole or so many first characters."""
    found = of_documents(corpus.select("doc_id", "body"), *fetched(ranked.select("rank", "doc_id")))
    return found.select("rank", "doc_id", _first_of("body", characters))


def fetch_regions(index: SearchIndex, ranked: DataFrame, characters: int | None = None, file: str | None = None) -> DataFrame:
    """(rank, doc_id, body): texts of some ranked documents from the tagged files, read where the documents table says.

    Only the regions of these documents are read. `file` stands in for the file the index was built from, if that
    is one and lies elsewhere now.
    """
    found = of_documents(index.docs.select("doc_id", "doc_size", "file", "offset"), *fetched(ranked.select("rank", "doc_id")))
    if file is not None:
        found = found.withColumn("file", F.lit(file))
    return regions_at(found).select("rank", "doc_id", _first_of("body", characters))


def _first_of(column: str, characters: int | None) -> Column:
    return F.col(column) if characters is None else F.substring(column, 1, characters).alias(column)


def rendered(results: DataFrame) -> Column:
    """A result as a line of text."""
    return F.format_string("[%d]\t%s\nBM25: \t%f", results["rank"], results["url"], results["bm25"])
